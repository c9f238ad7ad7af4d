"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Common function words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "der", "die", "das", "und", "ist", "von", "zu", "mit", "le", "la", "les", "de", "et", "des", "un", "une", "que", "el", "los", "en", "por", "para", "del", "se")
#: (numerator, lower bound, upper bound, denominator): lower * denominator <= numerator <= upper * denominator must hold, all in
#: hundredths of the denominator; None leaves a side open. A text that breaks one is dropped.
THRESHOLDS = (
    ("n_words", 2_000, None, "one"),
    ("word_chars", 200, 2_000, "n_words"),
    ("n_symbols", None, 10, "n_words"),
    ("n_stop_words", 2, None, "n_words"),
    ("n_dup_lines", None, 50, "n_lines"),
    ("n_upper_words", None, 50, "n_words"),
)


def measures(text: Column) -> dict[str, Column]:
    """The counted columns, in an order in which each may use those before it."""
    c = F.col
    whole = F.coalesce(text, F.lit(""))
    # Two references to _h keep Spark from moving its computation into the loop over windows.
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, F.lit(WINDOW))))
    # Equal windows have equal hashes. Only texts with equal hashes go on to compare the words themselves.
    exact = F.array_sort(F.transform(F.sequence(F.lit(0), c("_n") - F.lit(WINDOW)), lambda i: F.struct(F.array_join(F.slice("_words", i + F.lit(1), F.lit(WINDOW)), " ").alias("w"), i.alias("i"))))
    rows = F.size("_sorted")
    twice = F.array_sort(
        F.transform(
            F.filter(
                "_sorted",
                # the index of the filter is the place in the sorted array
                lambda x, k: ((k > 0) & (F.get("_sorted", k - 1)["w"] == x["w"])) | ((k < rows - 1) & (F.get("_sorted", k + 1)["w"] == x["w"])),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return {
        "_words": F.filter(F.split(whole, f"{SPACE}+"), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_n": F.size("_words"),
        "_h": F.when(c("_n") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))),
        "_windows": F.when(c("_n") >= WINDOW, windows),
        "_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), exact),
        "_twice": F.when(c("_sorted").isNotNull(), twice),
        "one": F.lit(1).cast("long"),
        "n_words": c("_n").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.when(c("_twice").isNotNull(), covered), F.lit(0)).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_upper_words": F.size(F.filter("_words", lambda w: w.rlike(r"^[^a-z]*[A-Z]{2}[^a-z]*$"))).cast("long"),
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    """All thresholds as one boolean of the counted columns."""
    kept = F.lit(True)
    for top, low, high, bottom in thresholds:
        if low is not None:
            kept = kept & (F.lit(100) * F.col(top) >= F.lit(low) * F.col(bottom))
        if high is not None:
            kept = kept & (F.lit(100) * F.col(top) <= F.lit(high) * F.col(bottom))
    return kept


def _judged(docs: DataFrame, keep: list[str], thresholds) -> DataFrame:
    out = docs.select(F.struct(*[docs[k] for k in keep]).alias("_kept"), docs["text"].alias("_text"))
    for name, column in measures(F.col("_text")).items():
        out = out.withColumn(name, column)
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return out.select("_kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"))


def apply_rules(docs: DataFrame, keep: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """The columns keep of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    No user functions and no shuffle: one row in, one row out, whole texts. Null and empty texts have no words and fail; repeated rows are
    judged alike; other columns, whatever their names, are packed away first. An empty table gives no rows.
    """
    out = _judged(docs, keep, thresholds)
    # through a generator, so that a later filter on these columns can't be pushed below and repeat their work
    row = F.struct("_kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(F.inline(F.array(row))).select("_kept.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_by_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """docs without those that the rules drop, in their own columns.

    Null and empty texts go; repeated rows stay or go alike; an empty table gives no rows; columns of any name are packed away and return.
    """
    # explode instead of where: a filter would be pushed below the projections and repeat all their work in its condition
    return _judged(docs, docs.columns, thresholds).select(F.explode(F.when(F.col("kept"), F.array("_kept"))).alias("_kept")).select("_kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), ["doc_id"])


def _sql_verdict() -> str:
    parts = []
    for top, low, high, bottom in THRESHOLDS:
        parts += [f"100 * {top} >= {low} * {bottom}"] * (low is not None) + [f"100 * {top} <= {high} * {bottom}"] * (high is not None)
    return " AND ".join(parts)


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM g) WHERE k > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n_repeat_words FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, 1 AS one,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(words, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(words, lambda x: regexp_matches(x, '^[^a-z]*[A-Z]{{2}}[^a-z]*$'))) AS BIGINT) AS n_upper_words
  FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_sql_verdict()}) AS kept
FROM m
"""
