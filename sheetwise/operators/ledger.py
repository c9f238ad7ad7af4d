"""The store's writes, as tables in and tables out: a caller writes the result as the table's next version. And its reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANUAL = "manual%"
#: Tables that a reset empties; documents, processing runs and page images stay.
CLEARED = ("corrections", "training_examples", "training_runs", "detections", "feature_cache", "candidate_outcomes", "dismissed_detections", "box_groups", "box_group_members")


# Writes


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Inserted detections, corrections, runs or outcomes; columns that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """rows replace the table's rows of the same keys (page images, runs, cached features); of equal keys among rows the greatest stays."""
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("_n")).select(*keys, "_n.*")
    return table.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of changes put over its own where they aren't null: label, box, text, confidence or polygon."""
    names = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def accept(detections: DataFrame, ids: DataFrame) -> DataFrame:
    """Corrections of the type accept, which copy label and box of the detections named by ids; an unknown id is an error when it is read."""
    found = ids.select("detection_id").join(detections, "detection_id", "left")
    known = lambda c: F.when(F.col("element_type").isNull(), F.raise_error(F.concat(F.lit("no detection "), F.col("detection_id").cast("string"))).cast("string")).otherwise(F.col(c))
    return found.select("detection_id", "doc_id", "page", F.lit("accept").alias("correction_type"), known("element_type").alias("original_element_type"), F.col("element_type").alias("corrected_element_type"), *[F.col(c).alias(f"corr_{c}") for c in ("x0", "y0", "x1", "y1")])


def stale(detections: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Detections of other runs than the one to keep of their document (doc_id, run_id; the latest if not given); manual ones stay."""
    runs = detections.where(~F.col("run_id").ilike(MANUAL))
    if keep is None:
        keep = runs.groupBy("doc_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return runs.join(keep.select("doc_id", F.col("run_id").alias("_kept")), "doc_id").where("run_id <> _kept").drop("_kept")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the detections in gone: corrections lose their reference and stay, what else refers to them goes.

    tables may hold detections, corrections, training_examples, dismissed_detections, box_groups (root_detection_id) and
    box_group_members; groups without members go too.
    """
    ids, out = gone.select("detection_id").distinct(), dict(tables)
    for name in ("detections", "training_examples", "dismissed_detections", "box_group_members"):
        if name in out:
            out[name] = out[name].join(ids, "detection_id", "left_anti")
    if "corrections" in out:
        table = out["corrections"]
        marked = table.join(ids.withColumn("_gone", F.lit(True)), "detection_id", "left")
        out["corrections"] = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "detection_id" else F.col(c) for c in table.columns])
    if "box_groups" in out:
        rooted = out["box_groups"].join(ids.withColumnRenamed("detection_id", "root_detection_id"), "root_detection_id", "left_anti")
        out["box_groups"] = rooted.join(out["box_group_members"].select("group_id").distinct(), "group_id", "left_semi")
    return out


def dismiss(dismissed: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(dismissed, rows, "detection_id")


def undismiss(dismissed: DataFrame, ids: DataFrame) -> DataFrame:
    return dismissed.join(ids.select("detection_id"), "detection_id", "left_anti")


def create_group(groups: DataFrame, members: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) with the groups in rows (group_id, root_detection_id, ...), each with its root as first member."""
    return append(groups, rows), append(members, rows.select("group_id", F.col("root_detection_id").alias("detection_id")))


def remove_from_groups(groups: DataFrame, members: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) without the members in rows (group_id, detection_id); a group whose root is among them goes as a whole."""
    gone = groups.join(rows.select("group_id", F.col("detection_id").alias("root_detection_id")), ["group_id", "root_detection_id"], "left_semi").select("group_id")
    left = members.join(rows.select("group_id", "detection_id"), ["group_id", "detection_id"], "left_anti")
    return groups.join(gone, "group_id", "left_anti"), left.join(gone, "group_id", "left_anti")


def settled_outcomes(candidates: DataFrame) -> DataFrame:
    """The candidates that may be stored as outcomes: hits and misses."""
    return candidates.where(F.col("outcome").isin("hit", "miss"))


def invalidate(cache: DataFrame, version: int | None = None) -> DataFrame:
    """The feature cache without rows of another version than this; without any if none is given."""
    return cache.where(F.lit(False)) if version is None else cache.where(F.col("feature_version") == version)


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: table.where(F.lit(False)) if name in CLEARED else table for name, table in tables.items()}


def snapshot(tables: dict[str, DataFrame], folder: str, tag: str) -> str:
    """Writes all tables under folder/tag and returns that path; a tag that is there already is an error."""
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{tag}/{name}")
    return f"{folder}/{tag}"


def restore(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


# Reports


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: documents with detections, detections, corrections and the latest time of each of the last two."""
    d = detections.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("detections"), F.max("created_at").alias("last_detection_at"))
    c = corrections.agg(F.count("*").alias("corrections"), F.max("corrected_at").alias("last_correction_at"))
    return d.join(F.broadcast(c))  # one row beside one row


def breakdown(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("n"))


def document_summary(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id, detections, corrections (by their detection's document), runs without manual ones, and last_activity, the latest of both."""
    located = corrections.join(detections.select("detection_id", "doc_id"), "detection_id")
    rows = detections.select("doc_id", F.lit(1).alias("d"), F.lit(0).alias("c"), F.when(~F.col("run_id").ilike(MANUAL), F.col("run_id")).alias("run"), F.col("created_at").cast("timestamp").alias("at"))
    rows = rows.unionByName(located.select("doc_id", F.lit(0).alias("d"), F.lit(1).alias("c"), F.lit(None).cast("string").alias("run"), F.col("corrected_at").cast("timestamp").alias("at")))
    return rows.groupBy("doc_id").agg(F.sum("d").alias("detections"), F.sum("c").alias("corrections"), F.countDistinct("run").alias("runs"), F.max("at").alias("last_activity"))


def run_ids(detections: DataFrame) -> DataFrame:
    """doc_id, run_id and place, 1 for the newest run of each document; manual ones left out."""
    runs = detections.where(~F.col("run_id").ilike(MANUAL)).groupBy("doc_id", "run_id").agg(F.max("created_at").alias("at"))
    return runs.select("doc_id", "run_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("run_id"))).alias("place"))


def recent(table: DataFrame, at: str, seq: str, n: int) -> DataFrame:
    """The n newest rows, ties to the higher seq: corrections, training runs, experiments."""
    return table.orderBy(F.desc(at), F.desc(seq)).limit(n)


def since(table: DataFrame, at: str, moment) -> DataFrame:
    return table.where(F.col(at) > F.lit(moment)).agg(F.count("*").alias("n"))


def page_extent(detections: DataFrame, width: float = 2448.0, height: float = 1584.0) -> DataFrame:
    """doc_id, page, width and height: the farthest edges of a page's boxes, or the defaults where there is none over 0."""
    edge = lambda c, other: F.when(F.max(c) > 0, F.max(c)).otherwise(other)
    return detections.groupBy("doc_id", "page").agg(edge("x1", width).alias("width"), edge("y1", height).alias("height"))


def newest_by(table: DataFrame, at: str, *keys: str) -> DataFrame:
    """The newest row of each key: page images of a page, runs of a document."""
    return table.groupBy(*keys).agg(F.max(F.struct(at, *[c for c in table.columns if c not in (at, *keys)])).alias("_n")).select(*keys, "_n.*")


def groups_with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, root_detection_id and members, an array in ascending order. A group holds a page's boxes at most."""
    listed = members.groupBy("group_id").agg(F.array_sort(F.collect_list("detection_id")).alias("members"))
    return groups.select("group_id", "root_detection_id").join(listed, "group_id", "left")


def groups_of(groups: DataFrame, members: DataFrame) -> DataFrame:
    """detection_id with the group that holds it."""
    return members.join(groups.select("group_id", "root_detection_id"), "group_id")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"), F.count("*").alias("total"))


def summary_metrics(by_class: DataFrame) -> DataFrame:
    """macro_f1, weighted_f1 (of the classes' rounded f1, 4 places) and accuracy-free support, from class_metrics."""
    whole = F.sum("support")
    return by_class.agg(F.bround(F.avg("f1"), 4).alias("macro_f1"), F.bround(F.when(whole > 0, F.sum(F.col("f1") * F.col("support")) / whole).otherwise(0.0), 4).alias("weighted_f1"), whole.alias("support"))


def confusion(pairs: DataFrame) -> DataFrame:
    """actual, predicted and n over the grid of all labels that occur in either."""
    labels = pairs.select(F.col("actual").alias("label")).union(pairs.select("predicted")).distinct()
    # labels of a classifier: a few dozen rows
    grid = labels.select(F.col("label").alias("actual")).join(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    return grid.join(pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").fillna(0, "n")


def symbol_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """symbol, hits, found and wanted as multisets: a hit for each pair, no more than either side has. From symbol on both sides."""
    both = found.groupBy("symbol").agg(F.count("*").alias("found")).join(truth.groupBy("symbol").agg(F.count("*").alias("wanted")), "symbol", "full_outer").fillna(0)
    return both.select("symbol", F.least("found", "wanted").alias("hits"), "found", "wanted")


def page_drift(checked: DataFrame, part: float = 0.5) -> DataFrame:
    """page, share of its samples that drifted, and drifted. From page and drifted."""
    return checked.groupBy("page").agg(F.avg(F.col("drifted").cast("double")).alias("share")).withColumn("drifted", F.col("share") >= part)


def evaluation_summary(results: DataFrame) -> DataFrame:
    """difficulty, n, mean score and share passed. From difficulty, score and passed."""
    return results.groupBy("difficulty").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg(F.col("passed").cast("double")).alias("passed"))


def producer_confidence(outcomes: DataFrame, base: float = 0.5, least: int = 3) -> DataFrame:
    """producer, method and confidence: the smoothed hit rate between 0.1 and 0.95 once there are `least` flagged, else the base."""
    by = outcomes.groupBy("producer", "method").agg(F.count("*").alias("flagged"), F.count_if(F.col("outcome") == "hit").alias("hits"))
    rate = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.bround((F.col("hits") + 1) / (F.col("flagged") + 2), 4)))
    return by.select("producer", "method", F.when(F.col("flagged") < least, F.lit(base)).otherwise(rate).alias("confidence"))


def first_of(rows: DataFrame, order: str, *keys) -> DataFrame:
    """The first row by order of each key; for entities of a page with one value in any case, or chunks of one id."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_nth = 1").drop("_nth")
