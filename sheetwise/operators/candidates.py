"""Places on a page where a symbol may be lost: detectors, the merge of what they find, and the best of each page.

Detectors take tokens with line_ix and give the keys, method, symbol, confidence and the padded box x0, y0, x1, y1. Those that look along a
line share one pass: neighbours and sums of the line stand in columns of one window, and every detector is an entry of one array that is
then unfolded, so that eight of them cost one shuffle. Digits are 0 to 9.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, overlaps, pad
from . import spatial
from .paged import by_page, numbers, ranges, spread

KEYS = ("doc_id", "page")
#: Words that ask for a symbol beside them.
KEYWORDS = {
    "°": ("ANGLE", "BEND", "DEG", "SLOPE", "TYP", "TYPICAL"),
    "±": ("ELEV", "EL", "TOL", "TOLERANCE"),
    "Ø": ("DIA", "DIAM", "DIAMETER"),
}
#: Words that ask for a symbol before them, after a number.
TEMPLATES = {"°": ("TYP", "TYP.", "TYP)"), "Ø": ("DIA", "DIAM", "DIAM.", "DIAMETER"), "±": ("TOL", "TOLERANCE")}
#: Words that go with a symbol somewhere in their line.
PARTNERS = {"@": ("OC", "O.C.", "O.C"), "#": ("BAR", "REBAR")}
UNITS = ("\"", "'", "MM", "CM", "M", "IN", "FT", "INCH", "INCHES", "FEET")
#: The symbols that are looked for, and texts of glyphs without a character.
SYMBOLS = "[%/°±Ø×'\"#@⌀]"
UNREAD = "\\uFFFD|\\x00|^\\(cid:"
LINE_METHODS = ("intraline_gap", "baseline_style_gap", "template_adjacency", "regex_digit_pattern", "impossible_sequence", "vocab_trigger", "keyword_cooccurrence", "semantic_no_units")


def _symbol_for(words: dict, t: Column) -> Column:
    return reduce(lambda c, s: c.when(t.isin(*words[s]), s), words, F.when(F.lit(False), "")).otherwise(None)


def has_digit(t: Column) -> Column:
    return t.rlike("[0-9]")


def all_digits(t: Column) -> Column:
    return t.rlike("^[0-9][0-9.,]*$")


def _place(method: str, symbol, confidence: float, at: Box, size: tuple[float, float], margin: float) -> Column:
    b = pad(at, margin, *size)
    symbol = symbol if isinstance(symbol, Column) else F.lit(symbol)
    return F.struct(F.lit(method).alias("method"), symbol.alias("symbol"), F.lit(confidence).alias("confidence"), *[v.alias(k) for k, v in b._asdict().items()])


def _between(left, right, narrow: float = 0.0) -> Box:
    """The room between two tokens of a line; three points to either side of its middle if it is narrower than that."""
    x0, x1 = left.x1, right.x0
    mid, tight = (x0 + x1) / 2, x1 - x0 < narrow
    return Box(F.when(tight, mid - 3).otherwise(x0), F.least(left.y0, right.y0), F.when(tight, mid + 3).otherwise(x1), F.greatest(left.y1, right.y1))


def beside(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Rows with before and after, the neighbours in the line by x0, y0 and token_ix, with gap, the room to the next, and with what the line
    holds: space (median positive gap), numbers, united (a unit) and held (an array of the partners' symbols)."""
    line = Window.partitionBy(*keys, "line_ix")
    order = line.orderBy("x0", "y0", "token_ix")
    ends = F.struct("x0", "y0", "x1", "y1", F.trim("text").alias("text"), "fontname", "font_size")
    t = F.trim("text")
    near = rows.select("*", F.lag(ends).over(order).alias("before"), F.lead(ends).over(order).alias("after")).withColumn("gap", F.col("after.x0") - F.col("x1"))
    unit = F.upper(t).isin(*UNITS) | (t.rlike("[\"']") & has_digit(t))
    held = F.array_compact(F.array(*[F.when(F.max(F.contains("text", F.lit(s))).over(line), s) for s in PARTNERS]))
    return near.select("*", F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5)).over(line).alias("space"), F.count_if(all_digits(t)).over(line).alias("numbers"), F.coalesce(F.max(unit).over(line), F.lit(False)).alias("united"), held.alias("held"))


def along_lines(rows: DataFrame, methods=LINE_METHODS, size=(612.0, 792.0), margin: float = 4.0, factor: float = 2.0, keys=KEYS) -> DataFrame:
    """What the detectors named find between neighbours of a line; a pair may be found by several, and once each.

    Null texts match nothing; a line of one token has no neighbours and only its missing unit could be told, which takes two numbers.
    """
    own, after, before = box(), box("after."), box("before.")
    t, a, b = F.trim("text"), F.col("after.text"), F.col("before.text")
    gap, back = F.col("gap"), F.col("x0") - F.col("before.x1")
    at = lambda method, symbol, confidence, where: _place(method, symbol, confidence, where, size, margin)
    wide = (gap > F.col("space") * factor) & (gap > 1)
    sizes = F.least("font_size", "after.font_size") / F.greatest("font_size", "after.font_size")
    alike = (F.col("fontname") == F.col("after.fontname")) & (F.col("fontname") != "") & ((F.col("font_size") <= 0) | (F.col("after.font_size") <= 0) | (sizes >= 0.85))
    key, needed = _symbol_for(KEYWORDS, F.upper(t)), _symbol_for(PARTNERS, F.upper(t))

    def beside_word(method, symbol, confidence, least: float | None):
        room = (lambda g: g >= least) if least is not None else (lambda g: g.isNotNull())
        return F.when(symbol.isNotNull() & has_digit(b) & room(back), at(method, symbol, confidence, _between(before, own, 1.0))).when(symbol.isNotNull() & has_digit(a) & room(gap), at(method, symbol, confidence, _between(own, after, 1.0)))

    pair = _between(own, after)
    found = {
        "intraline_gap": [F.when(wide, at("intraline_gap", "", 0.6, pair))],
        "baseline_style_gap": [F.when(wide & alike, at("baseline_style_gap", "", 0.7, pair))],
        "template_adjacency": [
            F.when(has_digit(t) & _symbol_for(TEMPLATES, F.upper(a)).isNotNull() & (gap >= 0.5), at("template_adjacency", _symbol_for(TEMPLATES, F.upper(a)), 0.85, pair)),
            F.when(F.upper(t).isin(*KEYWORDS["Ø"]) & has_digit(a) & (gap >= 0.5), at("template_adjacency", "Ø", 0.8, pair)),
        ],
        "regex_digit_pattern": [
            F.when(all_digits(t) & all_digits(a) & (gap >= 1), at("regex_digit_pattern", F.when(F.contains(t, F.lit(".")) & F.contains(a, F.lit(".")), "±").otherwise("×"), 0.55, pair)),
            F.when(has_digit(t) & a.rlike("[0-9]+/[0-9]+") & (gap > 1), at("regex_digit_pattern", '"', 0.5, pair)),
        ],
        "impossible_sequence": [F.when(all_digits(t) & all_digits(a) & gap.between(0.2, 20), at("impossible_sequence", "", 0.5, _between(own, after, 2.0)))],
        "vocab_trigger": [beside_word("vocab_trigger", key, 0.65, 0.5)],
        "keyword_cooccurrence": [F.when(~F.array_contains("held", needed), beside_word("keyword_cooccurrence", needed, 0.6, None))],
        "semantic_no_units": [F.when(all_digits(t) & (F.col("numbers") >= 2) & ~F.col("united"), at("semantic_no_units", '"', 0.4, Box(own.x1, own.y0, own.x1 + 6, own.y1)))],
    }
    places = F.array_compact(F.array(*[c for m in methods for c in found[m]]))
    return beside(rows, keys).select(*keys, F.inline(places))


def unread_tokens(tokens: DataFrame, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """placeholder_token: tokens without text or with glyphs that have no character, of half a point at least each way."""
    t = F.trim(F.coalesce("text", F.lit("")))
    bad = tokens.where(((t == "") | t.rlike(UNREAD)) & (F.col("x1") - F.col("x0") >= 0.5) & (F.col("y1") - F.col("y0") >= 0.5))
    return bad.select(*keys, F.inline(F.array(_place("placeholder_token", "", 0.85, box(), size, margin))))


def unread_chars(chars: DataFrame, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """char_encoding_failure for characters without text, unmapped_glyph for others that can't be read; half a point at least each way."""
    t = F.coalesce("text", F.lit(""))
    bad = chars.where(((t == "") | t.isin("�", "\x00") | t.startswith("(cid:")) & (F.col("x1") - F.col("x0") >= 0.5) & (F.col("y1") - F.col("y0") >= 0.5))
    place = _place("unmapped_glyph", "", 0.9, box(), size, margin)
    return bad.select(*keys, F.inline(F.array(place.withField("method", F.when(t == "", "char_encoding_failure").otherwise("unmapped_glyph")))))


def narrow_tokens(tokens: DataFrame, part: float = 0.7, unit: float = 0.55, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """token_width_anomaly: tokens narrower than `part` of what their characters and font size make likely."""
    likely = F.length("text") * F.col("font_size") * unit
    bad = tokens.where((F.trim("text") != "") & (F.col("font_size") > 0) & ((F.col("x1") - F.col("x0")) / likely < part))
    return bad.select(*keys, F.inline(F.array(_place("token_width_anomaly", "", 0.45, box(), size, margin))))


def bad_fonts(rows: DataFrame, chars: DataFrame, least: int = 3, rate: float = 0.05, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """font_subset_correlation: tokens beside a number whose font has at least `least` unread characters on the page and over that rate."""
    t = F.coalesce("text", F.lit(""))
    unread = (t == "") | t.isin("�", "\x00") | t.startswith("(cid:")
    fonts = chars.where("fontname <> ''").groupBy(*keys, "fontname").agg(F.count("*").alias("n"), F.count_if(unread).alias("failed")).where((F.col("failed") >= least) & (F.col("failed") > rate * F.col("n")))
    near = beside(rows, keys).where(has_digit(F.col("before.text")) | has_digit(F.col("after.text"))).join(fonts, [*keys, "fontname"], "left_semi")
    return near.select(*keys, F.inline(F.array(_place("font_subset_correlation", "", 0.5, box(), size, margin))))


def repeated_phrases(rows: DataFrame, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """cross_ref_phrase: runs of two or more tokens with digits whose texts stand elsewhere on the page too, in a line with a symbol, where
    their own line has none; the room between the first two."""
    line = Window.partitionBy(*keys, "line_ix")
    order = line.orderBy("x0", "y0", "token_ix")
    number = F.coalesce(has_digit(F.col("text")), F.lit(False))
    marked = rows.select(*keys, "line_ix", "x0", "y0", "x1", "y1", "token_ix", F.trim("text").alias("text"), number.alias("number"), F.sum((~number).cast("int")).over(order).alias("run"), F.coalesce(F.max(F.col("text").rlike(SYMBOLS)).over(line), F.lit(False)).alias("with_symbol"))
    members = F.array_sort(F.collect_list(F.struct("x0", "y0", "token_ix", "x1", "y1", "text")))
    runs = marked.where("number").groupBy(*keys, "line_ix", "run", "with_symbol").agg(members.alias("m")).where(F.size("m") >= 2)
    alike = Window.partitionBy(*keys, "phrase")
    counted = runs.withColumn("phrase", F.array_join(F.transform("m", lambda x: x["text"]), " ")).select("*", F.count("*").over(alike).alias("n"), F.count_if(F.col("with_symbol")).over(alike).alias("n_with"))
    ends = counted.where("n_with > 0 and n_with < n and not with_symbol").select(*keys, F.col("m")[0].alias("left"), F.col("m")[1].alias("right"))
    return ends.select(*keys, F.inline(F.array(_place("cross_ref_phrase", "", 0.75, _between(box("left."), box("right."), 1.0), size, margin))))


def near_duplicate_lines(rows: DataFrame, bare: bool = False, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """near_duplicate_line: lines of a page that differ in numbers only, where some hold a symbol and this one doesn't; the first gap over a
    point after a number. As numbers hold no symbols, lines that are alike hold the same ones and nothing is found, unless symbols are left
    out of the comparison too (bare)."""
    order = Window.partitionBy(*keys, "line_ix").orderBy("x0", "y0", "token_ix")
    ends = F.struct("x0", "y0", "x1", "y1")
    text = F.regexp_replace(F.trim("text"), r"[0-9]+\.?[0-9]*", "N")
    near = rows.select(*keys, "line_ix", "x0", "y0", "x1", "y1", "token_ix", "text", F.coalesce(F.regexp_replace(text, SYMBOLS, "") if bare else text, F.lit("")).alias("norm"), F.lead(ends).over(order).alias("after"))
    gap = has_digit(F.col("text")) & (F.col("after.x0") - F.col("x1") > 1)
    parts = F.array_sort(F.collect_list(F.struct("x0", "y0", "token_ix", "norm")))
    whole = near.groupBy(*keys, "line_ix").agg(F.array_join(F.transform(parts, lambda x: x["norm"]), "|").alias("print"), F.coalesce(F.max(F.col("text").rlike(SYMBOLS)), F.lit(False)).alias("with_symbol"), F.min(F.when(gap, F.struct("x0", "y0", "token_ix", "x1", "y1", "after"))).alias("left"))
    alike = Window.partitionBy(*keys, "print")
    counted = whole.select("*", F.count("*").over(alike).alias("n"), F.count_if(F.col("with_symbol")).over(alike).alias("n_with")).where("n_with > 0 and n_with < n and not with_symbol and left is not null")
    return counted.select(*keys, F.inline(F.array(_place("near_duplicate_line", "", 0.7, _between(box("left."), box("left.after.")), size, margin))))


def holes(tokens: DataFrame, cell: float = 20.0, least: int = 5, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """dense_cluster_hole: empty cells inside the page's grid with `least` or more of their eight neighbours touched by a token.

    Cells are cut to the page before they are unfolded, so that a box with a wild coordinate costs no more than a page of them.
    """
    last_c, last_r = (max(1, int(np.ceil(s / cell))) - 1 for s in size)
    # of columns that are doubles, so that coordinates beyond whole numbers don't overflow
    index = lambda k, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(k) / cell)).cast("int")
    span = tokens.select(*keys, index("x0", 0, last_c + 1).alias("c0"), index("x1", -1, last_c).alias("c1"), index("y0", 0, last_r + 1).alias("r0"), index("y1", -1, last_r).alias("r1")).where("c0 <= c1 and r0 <= r1")
    full = span.select(*keys, F.explode(F.sequence("c0", "c1")).alias("c"), "r0", "r1").select(*keys, "c", F.explode(F.sequence("r0", "r1")).alias("r")).distinct()
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = full.select(*keys, "c", "r", F.explode(steps).alias("s")).groupBy(*keys, (F.col("c") + F.col("s.i")).alias("c"), (F.col("r") + F.col("s.j")).alias("r")).agg(F.count_if((F.col("s.i") != 0) | (F.col("s.j") != 0)).alias("n"), F.count_if((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    empty = around.where((F.col("own") == 0) & (F.col("n") >= least) & F.col("c").between(1, last_c - 1) & F.col("r").between(1, last_r - 1))
    x, y = F.col("c") * cell, F.col("r") * cell
    return empty.select(*keys, F.inline(F.array(_place("dense_cluster_hole", "", 0.45, Box(x, y, x + cell, y + cell), size, margin))))


def small_circles(curves: DataFrame, tokens: DataFrame, most: float = 8.0, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """vector_circle_near_number: curves of three points or more, 1 to `most` points each way and about as wide as high, whose centre lies
    within three times that of the centre of a token with a digit. Curves: the keys, curve_ix, n_points and the extent."""
    w, h, reach = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), most * 3
    round_ = curves.where((F.col("n_points") >= 3) & w.between(1, most) & h.between(1, most) & (F.least(w, h) / F.greatest(w, h) >= 0.6))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    steps = lambda v: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(v / reach) + i))
    wide = round_.withColumn("cx", steps(x)).withColumn("cy", steps(y)).alias("c")
    numbers = tokens.where(has_digit(F.col("text"))).select(*keys, x.alias("tx"), y.alias("ty"), F.floor(x / reach).alias("cx"), F.floor(y / reach).alias("cy"))
    near = (F.abs(x - F.col("tx")) < reach) & (F.abs(y - F.col("ty")) < reach)
    hits = wide.join(numbers, [*keys, "cx", "cy"]).where(near).select(*keys, "curve_ix").distinct()
    return round_.join(hits, [*keys, "curve_ix"], "left_semi").select(*keys, F.inline(F.array(_place("vector_circle_near_number", "°", 0.55, box(), size, margin))))


def gaps_at_lines(drawn: DataFrame, rows: DataFrame, reach: float = 10.0, size=(612.0, 792.0), margin: float = 4.0, keys=KEYS) -> DataFrame:
    """dimension_geometry_proximity: gaps over two points within `reach` of a drawn line, a row for each line and gap."""
    own, after = box(), box("after.")
    wide = beside(rows, keys).where("gap > 2").select(*keys, F.struct(*[v.alias(k) for k, v in _between(own, after)._asdict().items()]).alias("g")).select(*keys, "g.*")
    grown = drawn.select(*keys, *[(F.col(k) + (-reach if k.endswith("0") else reach)).alias(k) for k in ("x0", "y0", "x1", "y1")])
    met = spatial.candidates(wide, grown, overlaps, keys)
    return met.select(*keys, F.inline(F.array(_place("dimension_geometry_proximity", "", 0.5, box(), size, margin))))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Places of a column's texts in their order, nulls last, and the texts."""
    texts = sorted(t for t in column.unique().to_pylist() if t is not None)
    at = {t: i for i, t in enumerate(texts)} | {None: len(texts)}
    known = column.combine_chunks().dictionary_encode()
    known = known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known
    places = np.array([*(at[t] for t in known.dictionary.to_pylist()), len(texts)])
    return places[known.indices.fill_null(len(places) - 1).to_numpy(zero_copy_only=False)], pa.array([*texts, None], pa.string())


def _first_takes(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of n rows in order, who takes each: the first before it that nobody took and that it is paired with, else itself. left < right."""
    state, owner, a, b = np.zeros(n, np.int8), np.arange(n), left, right
    while not state.all():
        waits = np.zeros(n, bool)
        waits[b] = True
        state[(state == 0) & ~waits] = 1
        state[b[state[a] == 1]] = 2
        open_ = (state[a] == 0) & (state[b] == 0)
        a, b = a[open_], b[open_]
    sure = state[left] == 1
    least = np.full(n, n)
    np.minimum.at(least, right[sure], left[sure])
    return np.minimum(owner, least)


def _merged(keys, threshold: float, most: int | None):
    def run(table: pa.Table, page: np.ndarray) -> pa.Table:
        confidence, *place = numbers(table, "confidence", "x0", "y0", "x1", "y1")
        (method, methods), (symbol, symbols) = _codes(table.column("method")), _codes(table.column("symbol"))
        order = np.lexsort((symbol, place[2], place[3], place[0], place[1], method, -confidence, page))
        page, confidence, method, symbol, x0, y0, x1, y1 = (v[order] for v in (page, confidence, method, symbol, *place))
        area, n = (x1 - x0) * (y1 - y0), len(page)
        # of two that overlap, the top of one lies within the other's height; by slices, so that pairs stay few
        by_top, start, stop = ranges(page, y0, page, y0, y1)
        where = np.empty(n, np.int64)
        where[by_top] = np.arange(n)
        start = where + 1
        bounds, left, right, at = np.r_[0, np.cumsum(np.maximum(stop - start, 0))], [], [], 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4_000_000, "right")) - 1)
            a, b = spread(start[at:end], stop[at:end])
            a, b = a + at, by_top[b]
            both = np.maximum(np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), 0) * np.maximum(np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b]), 0)
            first, second = np.minimum(a, b), np.maximum(a, b)
            union = area[second] + area[first] - both
            hit = (both > 0) & (union > 0) & (both >= threshold * union)
            left.append(first[hit])
            right.append(second[hit])
            at = end
        owner = _first_takes(n, np.concatenate(left), np.concatenate(right))
        kept = np.flatnonzero(owner == np.arange(n))
        own = np.argsort(owner, kind="stable")
        # the first row of each method of a candidate, in order
        _, first = np.unique(owner[own] * (len(methods) + 1) + method[own], return_index=True)
        first = own[np.sort(first)]
        said = np.flatnonzero(symbol != (symbols.index("").as_py() if "" in symbols.to_pylist() else -1))
        named = np.full(n, -1)
        named[owner[said[::-1]]] = said[::-1]
        rank = np.arange(len(kept)) - np.searchsorted(page[kept], page[kept]) + 1
        if most is not None:
            kept, rank = kept[rank <= most], rank[rank <= most]
        first = first[np.isin(owner[first], kept)]
        offsets = np.r_[np.searchsorted(owner[first], kept), len(first)].astype(np.int32)
        name = [symbols[int(symbol[i])].as_py() if i >= 0 else "" for i in named[kept].tolist()]
        null = lambda v: pa.array(v[kept], mask=np.isnan(v[kept]))
        columns = [*(table.column(k).take(pa.array(order[kept])) for k in keys), pa.ListArray.from_arrays(pa.array(offsets), methods.take(pa.array(method[first]))), pa.array(name, pa.string()), *map(null, (confidence, x0, y0, x1, y1))]
        return pa.table([*columns, *([] if most is None else [pa.array(rank.astype(np.int32))])], names=[*keys, "methods", "symbol", "confidence", "x0", "y0", "x1", "y1", *([] if most is None else ["rank"])])

    return run


def merge(found: DataFrame, threshold: float = 0.5, least: float = 0.3, keys=KEYS, most: int | None = None) -> DataFrame:
    """Candidates of confidence `least` or more, the surest first (ties by method, place and symbol); each takes those left that overlap it
    by the threshold, with their methods and, if it has none, their first symbol. Sequential within a page, whose sheet bounds its rows.

    With most, what surest would leave of them, with their rank: they are in that order already."""
    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "methods array<string>, symbol string, confidence double, x0 double, y0 double, x1 double, y1 double", *([] if most is None else ["rank int"])])
    slim = found.where(F.col("confidence") >= least).select(*keys, "method", "symbol", "confidence", "x0", "y0", "x1", "y1")
    return by_page(slim, _merged(keys, threshold, most), schema, keys)


def surest(merged: DataFrame, most: int = 200, keys=KEYS) -> DataFrame:
    """The `most` surest of each page, with their rank; ties by first method and place. The limit is the report's."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.col("methods")[0], "y0", "x0", "y1", "x1")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def statistics(found: DataFrame) -> DataFrame:
    """method, n, n_with_symbol and mean confidence of candidates."""
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("symbol") != "").alias("n_with_symbol"), F.avg("confidence").alias("mean_confidence"))
