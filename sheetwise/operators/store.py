"""The store of detections and corrections: latest versions, splits, metrics, statistics, drift, uncertainty, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(corrections: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """The latest correction of each detection, ties to the higher seq; without deletions unless asked for."""
    rows = corrections.where("detection_id is not null")
    rows = rows if keep_deleted else rows.where("correction_type <> 'delete'")
    return rows.groupBy("detection_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "detection_id"]), F.struct("corrected_at", "seq")).alias("_c")).select("detection_id", "_c.*")


def corrected(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """detection_id and element_type as their latest correction leaves them; deleted ones are gone."""
    last = latest(corrections, keep_deleted=True).select("detection_id", "correction_type", "corrected_element_type")
    joined = detections.join(last, "detection_id", "left").where("correction_type is null or correction_type <> 'delete'")
    return joined.select("detection_id", F.when(F.col("correction_type") == "relabel", F.col("corrected_element_type")).otherwise(F.col("element_type")).alias("element_type"))


def uncorrected(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    return detections.join(corrections.where("detection_id is not null").select("detection_id"), "detection_id", "left_anti")


def split(examples: DataFrame, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """example_id, label and split: by rank of the id's MD5 within the label, so that it never changes for the same rows."""
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("example_id").cast("string")), "example_id")) - 1
    share = place / F.count("*").over(Window.partitionBy("label"))
    return examples.select("example_id", "label", share.alias("_s")).select("example_id", "label", F.when(F.col("_s") < train, "train").when(F.col("_s") < train + val, "val").otherwise("test").alias("split"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1 (4 places) and support, from actual and predicted."""
    counts = pairs.groupBy("actual", "predicted").count()
    long = counts.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("said")))).alias("e"), F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("hit"))
    by = long.groupBy("e.label").agg(F.sum("e.support").alias("support"), F.sum("e.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return by.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support")


def compare_runs(a: DataFrame, b: DataFrame, step: float = 0.005) -> DataFrame:
    """label, delta of f1 and verdict between two runs' class metrics; a class that one lacks counts as 0 there."""
    both = a.select("label", F.col("f1").alias("a")).join(b.select("label", F.col("f1").alias("b")), "label", "full_outer")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 4)
    return both.select("label", delta.alias("delta"), F.when(delta > step, "better").when(delta < -step, "worse").otherwise("same").alias("verdict"))


def method_stats(outcomes: DataFrame) -> DataFrame:
    """method, flagged, hits, misses and hit_rate (hits over all flagged, pending too), from trigger_methods and outcome."""
    by = outcomes.select(F.explode("trigger_methods").alias("method"), "outcome").groupBy("method").agg(F.count("*").alias("flagged"), F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"))
    return by.withColumn("hit_rate", F.round(F.col("hits") / F.col("flagged"), 4))


def adaptive_confidence(base: Column, flagged: Column, hits: Column, least: int = 5) -> Column:
    """The smoothed hit rate between 0.1 and 0.95 once there are `least` flagged; the base before that."""
    return F.when(F.coalesce(flagged, F.lit(0)) < least, base).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.round((hits + 1) / (flagged + 2), 4))))


def page_uncertainty(detections: DataFrame) -> DataFrame:
    return detections.where("confidence is not null").groupBy("doc_id", "page").agg(F.avg(1 - F.col("confidence")).alias("uncertainty"), F.count("*").alias("n"))


def drift_fit(samples: DataFrame) -> DataFrame:
    """feature, mean, std (1 if near 0), p1 and p99 of each place of the vectors."""
    long = samples.select(F.posexplode("features").alias("feature", "value"))
    std = F.stddev_pop("value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.when(std < 1e-12, 1.0).otherwise(std).alias("std"), F.expr("percentile(value, 0.01)").alias("p1"), F.expr("percentile(value, 0.99)").alias("p99"))


def drift_check(samples: DataFrame, fitted: DataFrame, threshold: float = 0.3) -> DataFrame:
    """id, fraction of features outside their range, and drifted. fitted has one row for each place of the vectors."""
    long = samples.select("id", F.posexplode("features").alias("feature", "value")).join(fitted, "feature")
    outside = F.avg(((F.col("value") < F.col("p1")) | (F.col("value") > F.col("p99"))).cast("double"))
    return long.groupBy("id").agg(outside.alias("fraction")).withColumn("drifted", F.col("fraction") >= threshold)


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence, accuracy, and the bin's part of the expected calibration error. From confidence and correct (0 or 1)."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    by = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    # at most `bins` rows: a window without keys over them
    return by.withColumn("error", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.abs(F.col("confidence") - F.col("accuracy")))


def cosine_search(chunks: DataFrame, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
    """id, score (0 to 1, 4 places) and rank of the k nearest chunks by cosine; ties to the smaller id."""
    q = F.array(*[F.lit(float(v)) for v in vector])
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(v) ** 2 for v in vector) ** 0.5
    rows = chunks if where is None else chunks.where(where)
    scored = rows.select("id", F.round(F.greatest(F.lit(0.0), F.when(size * length > 0, dot / (size * length)).otherwise(0.0)), 4).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def latest_run(detections: DataFrame) -> DataFrame:
    """Each document's rows of its latest run, and its hand-drawn ones (run_id beginning with manual, in any case)."""
    manual = F.col("run_id").ilike("manual%")
    runs = detections.where(~manual).groupBy("doc_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("last_run"))
    return detections.join(runs, "doc_id", "left").where(manual | (F.col("run_id") == F.col("last_run"))).drop("last_run")


def next_page(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """The most uncertain page that has detections without a correction."""
    open_rows = uncorrected(detections, corrections).select("doc_id", "page").distinct()
    return page_uncertainty(detections).join(open_rows, ["doc_id", "page"], "left_semi").orderBy(F.desc("uncertainty"), "doc_id", "page").limit(1)


def merge_counters(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("method").agg(F.sum("flagged").alias("flagged"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost: tokens in and out at the model's price for a million, 0 for an unknown model."""
    priced = calls.join(prices, "model", "left")
    return priced.withColumn("cost", F.coalesce((F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6, F.lit(0.0))).drop("price_in", "price_out")
