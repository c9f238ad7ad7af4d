"""Mixing sources to target weights: certain whole copies, then Pareto order sampling with probabilities that rise with a document's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, source_key, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: The least bits of a document's size in each stratum but the last. Strata are drawn one after another, the longest documents first.
STRATA = (12, 9, 6)
#: Rates this close to a whole number are whole.
SNAP = 1e-9
#: Rows of a table with a row per source that may be broadcast; with more sources documents are joined by source and one of SALTS.
BROADCAST, SALTS = 100_000, 64
#: Cells of the histogram over the ranking, per level. Two levels leave about one row in BINS ** 2 to a final window.
BINS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(_key, source_size, target) from (_key, source, size): one row per source.

    Sources in code-point order, null last, take the weights in turn. Targets sum to share of all sizes and stop at most times their
    source's size; the excess goes to the others by weight until none is above. In closed form: sources in order of size per weight fill
    up first, and the first that doesn't fixes the level. Windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("_w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = ranked.withColumns(
        {
            "_level": (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        }
    )
    # the level rises while sources fill up and falls afterwards
    return filled.withColumn("_at", F.max("_level").over(everything)).select("_key", "source_size", F.least("_cap", F.col("_at") * F.col("_w")).alias("target"))


def uniform(*parts):
    """A number in (0, 1) that depends on nothing but the given strings: 52 bits of their MD5."""
    digest = F.md5(F.concat(*parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def by_source(rows: DataFrame, table: DataFrame, few: bool, *on: str) -> DataFrame:
    """rows joined (left) with a table of one row for each source, or source and class: broadcast if there are few, else by salted keys."""
    on = ["_key", *on]
    if few:
        return rows.join(F.broadcast(table), on, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size", "_hash"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], "left").drop("_salt")


def rates(sized: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_key, _class, _words, source_size, target, _whole, _p, _rest, _even): the copies that a document of each class of lengths should get.

    A class is the number of bits of a document's size. Copies rise in proportion to it, up to `most`, at a level that makes the words of a
    source meet its target: in closed form, as for the sources. A source has at most 64 classes. _rest: words beyond whole copies;
    _even: the inclusion odds if all classes had one probability, which only places documents in the histogram.
    """
    words = sized.groupBy("_key", "_class").agg(F.sum(F.col("size") * F.col("rows")).alias("_words"))
    joined = words.join(targets, "_key")
    longest_first = Window.partitionBy("_key").orderBy(F.desc("_class"))
    before, source = longest_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key")
    weighted = F.col("_words") * F.col("_class")
    open_weight = F.sum(weighted).over(source) - F.coalesce(F.sum(weighted).over(before), F.lit(0))
    open_words = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("_words").over(before), F.lit(0))
    level = joined.withColumn("_level", F.when(open_weight > 0, open_words / open_weight)).withColumn("_level", F.coalesce(F.max("_level").over(source), F.lit(0.0)))
    each = level.withColumn("_each", F.least(F.lit(float(most)), F.col("_level") * F.col("_class")))
    each = each.withColumn("_each", F.when(F.abs(F.col("_each") - F.round("_each")) < SNAP, F.round("_each")).otherwise(F.col("_each")))
    split = each.withColumn("_whole", F.floor("_each").cast("long")).withColumn("_p", F.col("_each") - F.col("_whole"))
    split = split.withColumn("_rest", F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(source))
    drawn = F.sum(F.when(F.col("_p") > 0, F.col("_words"))).over(source)
    mean = F.least(F.greatest(F.coalesce(F.col("_rest") / F.when(drawn > 0, drawn), F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return split.select("_key", "_class", "_words", "source_size", "target", "_whole", "_p", "_rest", (mean / (1 - mean)).alias("_even"))


def take_in_order(records: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """records with _in: how many of each record's rows are among the first of their source by _odds.

    wanted: _key, _want, _left, _later and _cut, a row per source. Rows are taken while their words stay within _want. The row that goes
    over it is taken if the part _cut of it stays within and all of it within _left, the words that this and the later strata need; also
    if the later strata's words, _later in all, would otherwise fall short by more than it goes over. Running sums come from two histogram
    levels of BINS cells over _bin and _sub, a monotone map of the odds, and a window over the one cell that the cut falls into, so a hot
    source is never in one task. Equal rows are one record.
    """

    def crossing(rows: DataFrame, cell: str, rest: str, out: str) -> DataFrame:
        """Per source the cell that holds the cut, and the words still wanted at its start."""
        sums = rows.groupBy("_key", cell).agg(F.sum(F.col("size") * F.col("rows")).alias("_sum"), F.first(rest).alias("_ends"))
        running = F.sum("_sum").over(Window.partitionBy("_key").orderBy(cell))
        return sums.withColumn("_through", running).where("_through >= _ends").groupBy("_key").agg(F.min(F.struct(cell, (F.col("_ends") - F.col("_through") + F.col("_sum")).alias("left"))).alias("_m")).select("_key", F.col(f"_m.{cell}").alias(out), F.col("_m.left").alias(f"{out}_left"))

    ranked = by_source(records, wanted, few)
    ranked = by_source(ranked, materialize(crossing(ranked, "_bin", "_want", "_at"), "mix-cut"), few)
    ranked = by_source(ranked, materialize(crossing(ranked.where("_bin = _at"), "_sub", "_at_left", "_fine"), "mix-fine"), few)
    full, none = F.col("rows"), F.lit(0).cast("long")
    # a source without a crossing takes all that it ranks
    before = F.col("_at").isNull() | (F.col("_bin") < F.col("_at")) | ((F.col("_bin") == F.col("_at")) & (F.col("_fine").isNull() | (F.col("_sub") < F.col("_fine"))))
    after = (F.col("_bin") > F.col("_at")) | (F.col("_sub") > F.col("_fine"))
    ranked = ranked.withColumn("_in", F.when(before, full).when(after, none))
    in_order = Window.partitionBy("_key").orderBy("_odds", "doc_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size")
    cut = ranked.where("_in is null").withColumn("_before", F.coalesce(F.sum(size * F.col("rows")).over(in_order), F.lit(0)))
    fit = F.when(size > 0, F.least(F.greatest(F.floor((F.col("_fine_left") - F.col("_before")) / size), none), full)).otherwise(none)
    # the words taken so far, and what the row at the cut finds
    cut = cut.withColumn("_in", fit.cast("long")).withColumn("_room", F.col("_fine_left") - F.col("_before") - F.col("_in") * size).withColumn("_need", F.col("_left") - F.col("_want") + F.col("_room"))
    over = (F.col("_in") < full) & (F.col("_room") > 0) & (((F.col("_cut") * size <= F.col("_room")) & (size <= F.col("_need"))) | ((F.col("_need") > F.col("_later")) & (size - F.col("_need") < F.col("_need") - F.col("_later"))))
    cut = cut.withColumn("_in", F.col("_in") + over.cast("long")).drop("_before", "_room", "_need")
    return ranked.where("_in is not null").unionByName(cut).drop("_want", "_left", "_later", "_cut", "_at", "_at_left", "_fine", "_fine_left")


def plan_records(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, salt: str = "mix") -> DataFrame:
    """One row for each distinct document: doc_id, source, _key, size, _hash (of the text), rows (how many are equal), source_size, target,
    _whole and _in (the copies that each row gets, and the rows that get one more)."""
    words = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash")).groupBy("doc_id", "source", "size", "_hash").agg(F.count("*").alias("rows"))
    sized = materialize(words.select("doc_id", "source", "size", "_hash", "rows", source_key(F.col("source")).alias("_key"), F.length(F.bin("size")).alias("_class")), "mix-sizes")
    targets = materialize(source_targets(sized.withColumn("size", F.col("size") * F.col("rows")), weights, share, most), "mix-targets")
    few = targets.count() <= BROADCAST
    stratum = reduce(lambda rest, j: F.when(F.col("_class") >= STRATA[j], j).otherwise(rest), reversed(range(len(STRATA))), F.lit(len(STRATA)))
    each = materialize(rates(sized, targets, most).withColumn("_stratum", stratum), "mix-rates")
    u = uniform(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))
    odds = u * (1 - F.col("_p")) / ((1 - u) * F.col("_p"))
    even = F.col("_odds") * F.col("_even")
    ranked = by_source(sized, each.drop("_words"), few, "_class").withColumn("_odds", F.when(F.col("_p") > 0, odds)).withColumn("_place", even / (1 + even) * BINS)
    ranked = ranked.withColumn("_bin", F.least(F.floor("_place"), F.lit(BINS - 1)).cast("int")).withColumn("_sub", F.least(F.floor((F.col("_place") - F.col("_bin")) * BINS), F.lit(BINS - 1)).cast("int"))
    ranked = materialize(ranked.drop("_place", "_even"), "mix-ranked")
    drawn = [F.sum(F.when((F.col("_p") > 0) & (F.col("_stratum") >= j), F.col("_words"))) for j in range(len(STRATA) + 2)]
    expected = [F.sum(F.when(F.col("_stratum") <= j, F.col("_p") * F.col("_words"))) for j in range(len(STRATA) + 1)]
    state = each.groupBy("_key").agg(
        F.first("_rest").alias("_rest"), F.sum(F.col("_p") * F.col("_words")).alias("_expected"), F.lit(0).cast("long").alias("_got"),
        *[F.coalesce(c, F.lit(0)).alias(f"_later{j}") for j, c in enumerate(drawn)], *[F.coalesce(c, F.lit(0.0)).alias(f"_upto{j}") for j, c in enumerate(expected)],
    )
    parts = [ranked.where("not _p > 0").withColumn("_in", F.lit(0).cast("long"))]
    for j in range(len(STRATA) + 1):
        state = materialize(state, "mix-state")
        left, later = F.col("_rest") - F.col("_got"), F.col(f"_later{j + 1}")
        due = F.when(F.col("_expected") > 0, F.col("_rest") * F.col(f"_upto{j}") / F.col("_expected")).otherwise(0.0) - F.col("_got")
        want = F.greatest(F.least(due, left), left - later)
        wanted = state.select("_key", want.alias("_want"), left.alias("_left"), later.cast("double").alias("_later"), uniform(F.lit(f"{salt}cut{j}:"), F.col("_key")).alias("_cut"))
        taken = take_in_order(ranked.where((F.col("_p") > 0) & (F.col("_stratum") == j)), wanted, few)
        if j < len(STRATA):
            taken = materialize(taken, "mix-taken")
            got = taken.groupBy("_key").agg(F.sum(F.col("_in") * F.col("size")).alias("_more"))
            state = state.join(got, "_key", "left").withColumn("_got", F.col("_got") + F.coalesce("_more", F.lit(0).cast("long"))).drop("_more")
        parts.append(taken)
    columns = ["doc_id", "source", "_key", "size", "_hash", "rows", "source_size", "target", "_whole", "_p", "_in"]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in parts])


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source and inclusion.

    A source wants copies of each document that rise with the bits of its length and meet the target in words (rates): the whole part is
    certain, the fraction is its inclusion probability for one more. Documents of a source rank by their random odds u / (1 - u) over their
    inclusion odds p / (1 - p), ties by doc_id, size and text hash, and the first are taken up to a fixed number of words, the same in every
    run. Long documents are drawn first, each stratum of lengths up to its expected words; shorter ones fill up what the row at a cut leaves
    or takes too much, so that a source's sum ends within half a short document of its target, as far as it has such documents. Null or
    empty texts have size 0 and take 0 words; a null source is a source of its own; repeated rows count as documents of their own; an empty
    table gives no rows; other columns are ignored.
    """
    records = plan_records(docs, **options)
    # the first _in rows of a record get one more
    row = F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row")
    copies = F.col("_whole") + (F.col("_row") <= F.col("_in")).cast("long")
    return records.select("*", row).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", F.col("_p").alias("inclusion"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as plan_mix says, in the columns of docs. Equal rows share one record's copies.

    Texts are shuffled once at most: the window that tells equal rows apart takes over the partitioning of the join. Clashing names are
    packed away; nulls, ties, repeated rows and empty tables are as in plan_mix.
    """
    plan = plan_records(docs, **options).select(*_identity("_hash"), (F.col("_whole") * F.col("rows") + F.col("_in")).alias("_copies"), F.col("rows").alias("_rows"))
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_kept"), "doc_id", "source", F.xxhash64("text").alias("_hash")).select("_kept", *_identity("_hash"))
    joined = kept.join(plan, ["_id", "_row"])
    # each of k equal rows takes an equal part of their copies, and the first ones the remainder
    place = F.row_number().over(Window.partitionBy("_id", "_row").orderBy("_rows"))
    own = F.floor(F.col("_copies") / F.col("_rows")) + (place <= F.col("_copies") % F.col("_rows")).cast("long")
    return joined.withColumn("_own", own).where("_own > 0").select("_kept", F.explode(F.sequence(F.lit(1).cast("long"), "_own")).alias("_copy")).select("_kept.*")


def _identity(text_hash: str) -> list:
    """Two columns without nulls that equal rows share: the doc_id, and a hash of doc_id, source and text."""
    return [F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64(F.col("doc_id"), source_key(F.col("source")), F.col(text_hash)).alias("_row")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql_strata() -> str:
    """A table x0, x1, ... for each stratum, with chosen."""
    key, parts, got = "CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END", [], "0"
    for j in range(len(STRATA) + 1):
        own = f"stratum = {j}"
        if j:
            got += f" + coalesce((SELECT sum(size * chosen) FROM x{j - 1} WHERE x{j - 1}.source IS NOT DISTINCT FROM z.source), 0)"
        parts.append(f"""
z{j} AS (SELECT source, remaining, later, cut, greatest(least(due, remaining), remaining - later) AS want FROM (
  SELECT source, rest - ({got}) AS remaining, CASE WHEN expected > 0 THEN rest * upto{j} / expected ELSE 0 END - ({got}) AS due, later{j + 1} AS later,
  (CAST('0x' || substr(md5('mixcut{j}:' || {key}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS cut FROM z)),
x{j} AS (SELECT doc_id, source, size, source_size, target, whole, CASE WHEN before + size <= want THEN 1 WHEN before >= want THEN 0
  WHEN cut * size <= want - before AND before + size <= remaining THEN 1 WHEN remaining - before > later AND size - (remaining - before) < remaining - before - later THEN 1 ELSE 0 END AS chosen
  FROM (SELECT o.*, want, remaining, later, cut, sum(size) OVER (PARTITION BY o.source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
    FROM o JOIN z{j} ON o.source IS NOT DISTINCT FROM z{j}.source WHERE p > 0 AND {own}))""")
    return ",".join(parts)


_STRATUM = "CASE " + " ".join(f"WHEN class >= {bits} THEN {j}" for j, bits in enumerate(STRATA)) + f" ELSE {len(STRATA)} END"
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1] AS DOUBLE) AS w, {float(MOST)}::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM f),
b AS (SELECT source, length(bin(CAST(size AS BIGINT))) AS class, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
l AS (SELECT b.*, source_size, target, CASE WHEN sum(words * class) OVER (PARTITION BY b.source) - coalesce(sum(words * class) OVER o, 0) > 0 THEN
  (target - {float(MOST)}::DOUBLE * coalesce(sum(words) OVER o, 0)) / (sum(words * class) OVER (PARTITION BY b.source) - coalesce(sum(words * class) OVER o, 0)) END AS level
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY b.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, least({float(MOST)}::DOUBLE, coalesce(max(level) OVER (PARTITION BY source), 0) * class) AS rate FROM l),
n AS (SELECT *, CASE WHEN abs(rate - round(rate)) < {SNAP} THEN round(rate) ELSE rate END AS each FROM e),
p AS (SELECT *, CAST(floor(each) AS BIGINT) AS whole, each - floor(each) AS p, target - sum(floor(each) * words) OVER (PARTITION BY source) AS rest, {_STRATUM} AS stratum FROM n),
z AS (SELECT source, any_value(rest) AS rest, sum(p * words) AS expected, {', '.join(f"coalesce(sum(words) FILTER (p > 0 AND stratum >= {j}), 0) AS later{j}, coalesce(sum(p * words) FILTER (stratum <= {j}), 0) AS upto{j}" for j in range(len(STRATA) + 2))}
  FROM p GROUP BY source),
c AS (SELECT d.*, source_size, target, whole, p, stratum,
  (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(CAST(d.size AS BIGINT))) = class),
o AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS odds FROM c),{_sql_strata()}
SELECT doc_id, size, source_size, target, CAST(size * (whole + chosen) AS BIGINT) AS taken
FROM ({' UNION ALL '.join(f"SELECT doc_id, size, source_size, target, whole, chosen FROM x{j}" for j in range(len(STRATA) + 1))} UNION ALL SELECT doc_id, size, source_size, target, whole, 0 FROM o WHERE p = 0)
"""
