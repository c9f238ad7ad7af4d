import math
import random
import statistics

from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.functions import text as T
from sheetwise.operators import checks, lines, spatial, store
from sheetwise.sources import io

TOKENS = "doc_id bigint, page bigint, token_ix bigint, x0 double, y0 double, x1 double, y1 double, text string"


def tokens(spark, *rows):
    return spark.createDataFrame([(0, 0, i, *map(float, r[:4]), r[4]) for i, r in enumerate(rows)], TOKENS)


def test_nms_keeps_larger_boxes_of_each_document(spark):
    """A chain where the middle box goes and the ends, which overlap nothing kept, stay; equal boxes of another document are its own."""
    one = [(0, 0, 40, 10, "wide"), (20, 0, 55, 10, "middle"), (45, 0, 70, 10, "end"), (70, 0, 80, 10, "touching"), (0, 0, 40, 10, "again")]
    frame = tokens(spark, *one)
    both = frame.unionByName(frame.withColumn("doc_id", F.lit(1).cast("bigint")))
    kept = sorted((r["doc_id"], r["text"]) for r in spatial.nms(both, 0.3).collect())
    assert kept == [(d, t) for d in (0, 1) for t in ("end", "touching", "wide")]
    clusters = {(r["doc_id"], r["token_ix"]): r["cluster"] for r in spatial.overlap_clusters(both).collect()}
    assert clusters == {(d, i): 3 if i == 3 else 0 for d in (0, 1) for i in range(5)}


def test_lines_by_first_fit(spark):
    """Lines by median height, numbered from the top and left; tokens that overlap too little or lie too far start a line of their own."""
    r = random.Random(5)
    made = [(x, y + r.choice([0, 1, 2, 3]), x + 20, y + r.choice([9, 10, 11]), "t") for y in range(0, 200, 25) for x in range(0, 300, 40)] + [(400, 4, 410, 30, "tall")]
    got = {x["token_ix"]: x["line_ix"] for x in lines.build_lines(tokens(spark, *made)).collect()}
    heights = sorted(m[3] - m[1] for m in made)
    tolerance = heights[len(heights) // 2] * 0.45
    groups = []
    for i, m in sorted(enumerate(made), key=lambda z: ((z[1][1] + z[1][3]) / 2, z[1][0])):
        c = (m[1] + m[3]) / 2
        for g in groups:
            top, bottom = min(made[k][1] for k in g), max(made[k][3] for k in g)
            mean = sum((made[k][1] + made[k][3]) / 2 for k in g) / len(g)
            if abs(c - mean) <= tolerance and (min(m[3], bottom) - max(m[1], top)) / (min(m[3] - m[1], bottom - top) + 1e-6) > 0.3:
                g.append(i)
                break
        else:
            groups.append([i])
    groups.sort(key=lambda g: (statistics.median((made[k][1] + made[k][3]) / 2 for k in g), min(made[k][0] for k in g)))
    assert got == {i: k for k, g in enumerate(groups) for i in g}
    spans = lines.spans(lines.lined(tokens(spark, (0, 0, 10, 10, "a"), (14, 0, 24, 10, "b"), (28, 1, 38, 11, "c"), (400, 0, 410, 10, "far"), (0, 50, 10, 60, "low"))))
    assert [(x["line_ix"], x["span_ix"]) for x in spans.orderBy("token_ix").collect()] == [(0, 0), (0, 0), (0, 0), (0, 1), (1, 0)]


def test_touching_boxes_overlap_only_if_asked(spark):
    row = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "x0 double, y0 double, x1 double, y1 double, x0_r double, y0_r double, x1_r double, y1_r double")
    a, b = G.box(), G.box(suffix="_r")
    assert row.select(G.overlaps(a, b), G.overlaps(a, b, touching=True), G.iou(a, b)).first()[:] == (False, True, 0.0)


def test_text(spark):
    row = spark.createDataFrame([("GENERAL NOTES (CONT'D):", "03/04/21", "2%°", "Acrobat Distiller 9.5 (x)", "ABCDEF+Arial")], "h string, d string, s string, p string, f string")
    out = row.select(T.base_header(F.col("h")), T.is_continuation(F.col("h")), T.parse_date(F.col("d")).cast("string"), T.extra_symbols(F.col("s"), F.lit("2"), "%°"), T.producer_name(F.col("p")), T.font_name(F.col("f")), T.keyword_recall(F.lit("Seal the Drain"), F.array(F.lit("drain"), F.lit("roof")))).first()
    assert out[:] == ("GENERAL NOTES", True, "2021-03-04", "%°", "acrobat distiller", "Arial", 0.5)


def test_invalid_dates_are_null(spark):
    assert spark.createDataFrame([("13/45/2020",), (None,), ("none",)], "d string").where(T.parse_date(F.col("d")).isNotNull()).isEmpty()


def test_dates(spark):
    """Year first, then month first, then names of months; what is no date is null."""
    want = {"2001-04-02": "2001-04-02", "2001-31-12": "2012-01-31", "12 Jan 2024": "2024-01-12", "March 3, 99": "2099-03-03", "sept 4 2020": None, "Sep 31 2020": None, "5/6/21 or 2020-01-02": "2020-01-02", "REV 07-08-19": "2019-07-08", "May 2021": None}
    got = spark.createDataFrame([(k,) for k in want], "d string").select("d", T.parse_date(F.col("d")).cast("string")).collect()
    assert {r[0]: r[1] for r in got} == want


def test_headers(spark):
    rows = {"NOTES (CONT\u2019D):": ("NOTES", True), "Notes Continued": ("NOTES", False), "NOTES CONTINUED: ": ("NOTES", True), "CONTROL NOTES::": ("CONTROL NOTES", False), "CONT'D FROM LEFT": ("CONT'D FROM LEFT", False)}
    got = spark.createDataFrame([(k,) for k in rows], "h string").select("h", T.base_header(F.col("h")), T.is_continuation(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == rows


def test_checks_keep_to_their_page(spark):
    """A note of page 2 doesn't define a reference of page 1, nor one of another document; a misread number costs one finding."""
    notes = spark.createDataFrame([(1, 1, 0, 0, 1, "SEE NOTE 7"), (1, 2, 0, 1, 7, "x"), (2, 1, 0, 2, 7, "x"), (1, 1, 0, 3, 2_000_000, "x")], "doc_id int, page int, column_ix int, ord int, number int, text string")
    assert [(r["doc_id"], r["page"], r["subject"]) for r in checks.undefined_references(notes, notes).collect()] == [(1, 1, "7")]
    gaps = {(r["doc_id"], r["page"]): r["subject"] for r in checks.numbering(notes).where("check_id = 'NOTES_GAP'").collect()}
    assert gaps == {(1, 1): "2-1999999", (1, 2): "1-6", (2, 1): "1-6"}


def test_metrics_of_an_empty_table(spark):
    assert store.class_metrics(spark.createDataFrame([], "actual string, predicted string")).isEmpty()


def test_curves_without_points_are_dropped(spark):
    none = spark.createDataFrame([], "page int, x0 double, y0 double, x1 double, y1 double")
    curves = spark.createDataFrame([(0, [(1.0, 5.0), (3.0, 2.0)]), (0, [])], "page int, pts array<struct<x:double,y:double>>")
    lines_ = spark.createDataFrame([(0, 9.0, 9.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r[:] for r in io.graphics(lines_, none, curves).collect()) == [(0, "curve", 1.0, 2.0, 3.0, 5.0), (0, "line", 1.0, 1.0, 9.0, 9.0)]


def test_examples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "notes", {"f": 1.0}, "train")], "example_id string, label string, features map<string,double>, split string")
    io.write_examples(rows, str(tmp_path / "x"))
    assert io.read_examples(spark, str(tmp_path / "x")).collect() == rows.collect()


def test_documents_are_known_by_content(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"%PDF-1.7 x"), ("c.pdf", b""), ("d.txt", b"text")):
        (tmp_path / name).write_bytes(content)
    found = io.register_documents(spark, str(tmp_path))
    assert found.count() == 2 and found.select("doc_id").distinct().count() == 1


def test_symbols_take_free_rows_in_order(spark):
    """By all pairs: each symbol in order takes the nearest row to its right that no symbol before it took."""
    r = random.Random(3)
    symbols = [(d, 1, i, float(x := r.randint(0, 200)), float(y := r.randint(0, 300)), x + 12.0, y + 12.0) for d in (0, 1) for i in range(25)]
    rows = [(d, 1, i, float(x := r.randint(100, 450)), float(y := r.randint(0, 300)), x + 90.0, y + 10.0) for d in (0, 1) for i in range(20)]
    schema = "doc_id bigint, page bigint, {} bigint, x0 double, y0 double, x1 double, y1 double"
    got = spatial.pair_symbols(spark.createDataFrame(symbols, schema.format("symbol_ix")), spark.createDataFrame(rows, schema.format("row_ix"))).collect()
    want, taken = set(), set()
    for s in symbols:
        near = [(t[3] - s[5] + abs((t[4] + t[6]) / 2 - (s[4] + s[6]) / 2), t[2]) for t in rows if t[0] == s[0] and 0 <= t[3] - s[5] <= 300 and abs((t[4] + t[6]) / 2 - (s[4] + s[6]) / 2) <= 20 and (s[0], t[2]) not in taken]
        best = min(near)[1] if near else None
        taken.add((s[0], best))
        want.add((s[0], 1, s[2], best))
    assert {tuple(x) for x in got} == want


def test_slope_of_tokens_above_each_other(spark):
    """Such a line has no slope, but it weighs, behind all others, as in the query's SQL; tokens without a place make no line."""
    line = lambda ix, *at: [(0, 0, ix, float(x), float(y), x + 2.0, y + 9.0) for x, y in at]
    rows = line(0, (0, 0), (100, 1)) + line(1, (0, 20), (100, 22)) + line(2, (5, 40), (5, 46), (5, 47)) + [(0, 0, 3, None, None, None, None)] * 9
    frame = spark.createDataFrame(rows, "doc_id bigint, page bigint, line_ix int, x0 double, y0 double, x1 double, y1 double")
    slopes = {r["line_ix"]: (r["weight"], round(r["slope"], 9)) for r in lines.line_slopes(frame, 2).collect()}
    assert slopes[0] == (2, 0.01) and slopes[1] == (2, 0.02) and slopes[2][0] == 3 and slopes[2][1] != slopes[2][1] and len(slopes) == 3
    assert round(lines.skew(lines.line_slopes(frame, 2)).first()["degrees"], 6) == round(math.degrees(math.atan(0.02)), 6)


def test_symbols_are_not_unfolded_into_cells(spark):
    """Nor do pages that go together, repeats or missing numbers change what is paired."""
    schema = "doc_id bigint, page bigint, {} bigint, x0 double, y0 double, x1 double, y1 double"
    symbols = [(0, p, 0, 0.0, 0.0, 10.0, 10.0) for p in range(3)] * 2 + [(0, 1, None, 0.0, 0.0, 10.0, 10.0), (None, 1, 0, 0.0, 0.0, 10.0, 10.0), (0, 2, 1, 0.0, 0.0, 10.0, 10.0)]
    rows = [(0, 1, 7, 20.0, 0.0, 30.0, 10.0), (0, 1, 8, None, 0.0, 30.0, 10.0), (0, 2, 9, 310.0, 20.0, 320.0, 30.0), (None, 1, 9, 20.0, 0.0, 30.0, 10.0)]
    got = spatial.pair_symbols(spark.createDataFrame(symbols, schema.format("symbol_ix")), spark.createDataFrame(rows, schema.format("row_ix")))
    want = [(0, 0, 0, None), (0, 1, 0, 7), (0, 2, 0, 9)] * 2 + [(0, 1, None, None), (None, 1, 0, None), (0, 2, 1, None)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_unfolded_boxes_are_not_broadcast(spark):
    boxes = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 600.0, 700.0)], "doc_id bigint, page bigint, token_ix bigint, x0 double, y0 double, x1 double, y1 double")
    assert "Broadcast" not in spatial.candidates(boxes, boxes, G.overlaps)._jdf.queryExecution().executedPlan().toString()
