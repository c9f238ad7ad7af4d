import random

from pyspark.sql import functions as F

from sheetwise.operators import blocks, candidates, lines, regions

BLOCKS = "doc_id bigint, page bigint, block_ix int, x0 double, y0 double, x1 double, y1 double, n_lines bigint, text string, header boolean, notes boolean"
TOKENS = "doc_id bigint, page bigint, token_ix bigint, x0 double, y0 double, x1 double, y1 double, text string, fontname string, font_size double"


def words(*rows):
    """Tokens of 8 points a letter and 10 points high, from (x, y, text) or (x, y, text, font, size)."""
    out, ix = [], 0
    for x, y, text, *more in rows:
        for w in text.split(" "):
            out.append((0, 0, ix, float(x), float(y), float(x + 8 * len(w)), float(y + 10), w, *(more or ["Plain", 10.0])))
            x, ix = x + 8 * len(w) + 5, ix + 1
    return out


def test_blocks_and_columns_of_a_page(spark):
    """Headers, notes, a number that stands alone, a large gap and two columns, the right one without a header of its own."""
    page = words((40, 40, "SITE NOTES:"), (40, 60, "1. CLEAN ALL"), (40, 71, "EDGES"), (40, 90, "2. PAINT"), (40, 200, "loose text"), (400, 40, "3. SWEEP IT"), (400, 60, "4."), (400, 72, "LOCK"), (400, 300, "BIG TITLE", "Some-Bold", 10.0))
    made = blocks.blocks_of(spark.createDataFrame(page, TOKENS)).orderBy("block_ix").collect()
    assert [(r["text"], r["n_lines"], r["header"], r["notes"]) for r in made] == [
        ("SITE NOTES:", 1, True, False), ("3. SWEEP IT", 1, False, True), ("1. CLEAN ALL", 2, False, True), ("4.", 2, False, True), ("2. PAINT", 1, False, True), ("LOOSE TEXT", 1, False, False), ("BIG TITLE", 1, True, False)
    ]
    columns = blocks.notes_columns(spark.createDataFrame([tuple(r[c] for c in ("doc_id", "page", "block_ix", "x0", "y0", "x1", "y1", "n_lines", "text", "header", "notes")) for r in made], BLOCKS))
    got = {r["block_ix"]: (r["column_ix"], r["header_text"], r["continues"], r["group_ix"]) for r in columns.collect()}
    left, right = (0, "SITE NOTES:", None, 0), (1, None, "SITE NOTES:", 0)
    assert got == {0: left, 2: left, 4: left, 1: right, 3: right, 6: (2, "BIG TITLE", None, None)}


def test_short_note_joins_the_next_block(spark):
    """A note of two words or fewer joins the block that comes next from the top, within the gap, whichever column that stands in."""
    near = blocks.blocks_of(spark.createDataFrame(words((40, 40, "3. SWEEP"), (400, 55, "LOCK ALL DOORS")), TOKENS)).collect()
    far = blocks.blocks_of(spark.createDataFrame(words((40, 40, "3. SWEEP"), (400, 95, "LOCK ALL DOORS")), TOKENS)).collect()
    assert [r["n_lines"] for r in near] == [2] and sorted(r["n_lines"] for r in far) == [1, 1]


def test_columns_without_headers(spark):
    rows = [(0, 0, 0, 10.0, 10.0, 90.0, 20.0, 1, "1. A", False, True), (0, 0, 1, 300.0, 10.0, 390.0, 20.0, 1, "2. B", False, True)]
    got = [(r["column_ix"], r["header_text"], r["continues"], r["group_ix"]) for r in blocks.notes_columns(spark.createDataFrame(rows, BLOCKS)).orderBy("block_ix").collect()]
    assert got == [(0, None, None, None), (1, None, None, None)]
    assert blocks.notes_columns(spark.createDataFrame([], BLOCKS)).count() == 0


def test_clusters_of_running_means():
    assert blocks.clusters([0.0, 8.0, 13.0, 30.0, 41.0], 10.0) == [0, 0, 0, 1, 2]
    assert blocks.clusters([], 1.0) == []


def test_title_fields(spark):
    """A value in the label's row, one in the next, a second label that doesn't count, and values without labels."""
    rows = [(0, 0, 0, 1.0, "Project Name: North Pier"), (0, 0, 1, 2.0, "SHEET NO."), (0, 0, 2, 3.0, "C-12"), (0, 0, 3, 4.0, "Project title: Other"), (0, 0, 4, 5.0, "1\" = 20'"), (0, 0, 5, 6.0, "issued 3/4/21"), (0, 0, 6, 7.0, None), (0, 1, 0, 0.0, "nothing")]
    got = {r["label"]: (r["value"], r["confidence"], r["block_confidence"]) for r in regions.title_fields(spark.createDataFrame(rows, "doc_id bigint, page bigint, row_ix bigint, y0 double, text string")).collect()}
    assert got == {"project_name": ("North Pier", 0.85, 1.0), "sheet_number": ("C-12", 0.85, 1.0), "scale": ("1\" = 20'", 0.6, 1.0), "date": ("3/4/21", 0.55, 1.0)}


def test_merge_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for page in range(3):
        for _ in range(40):
            x, y = r.randrange(0, 60, 3), r.randrange(0, 30, 5)
            rows.append((0, page, r.choice("abc"), r.choice(["", "%", "#"]), r.choice([0.2, 0.4, 0.6]), float(x), float(y), float(x + 12), float(y + 10)))
    found = spark.createDataFrame(rows, "doc_id bigint, page bigint, method string, symbol string, confidence double, x0 double, y0 double, x1 double, y1 double")
    want = []
    for page in range(3):
        left = sorted((t for t in rows if t[1] == page and t[4] >= 0.3), key=lambda t: (-t[4], t[2], t[6], t[5], t[8], t[7], t[3]))
        while left:
            k = left[0]
            both = lambda t: max(0.0, min(t[7], k[7]) - max(t[5], k[5])) * max(0.0, min(t[8], k[8]) - max(t[6], k[6]))  # noqa: B023, E731
            mine = [t for t in left if t is k or both(t) / (240 - both(t)) >= 0.5]
            left = [t for t in left if not any(t is m for m in mine)]
            want.append((page, tuple(dict.fromkeys(t[2] for t in mine)), next((t[3] for t in mine if t[3]), ""), k[4], *k[5:]))
    got = [(x["page"], tuple(x["methods"]), x["symbol"], x["confidence"], x["x0"], x["y0"], x["x1"], x["y1"]) for x in candidates.merge(found).collect()]
    assert sorted(got) == sorted(want)
    assert candidates.surest(candidates.merge(found), 2).groupBy("page").count().agg(F.max("count")).first()[0] == 2


def test_alike_lines_need_bare_symbols(spark):
    """Lines that are alike but for numbers hold the same symbols, so one without a symbol is found only if symbols aren't compared."""
    rows = [(0, 0, i, 0, 0.0, 0.0, 10.0, 10.0, t) for i, t in enumerate(("5%",))] + [(0, 0, 1, 0, 20.0, 0.0, 30.0, 10.0, "A"), (0, 0, 2, 1, 0.0, 20.0, 10.0, 30.0, "7"), (0, 0, 3, 1, 20.0, 20.0, 30.0, 30.0, "A")]
    frame = spark.createDataFrame(rows, "doc_id bigint, page bigint, token_ix bigint, line_ix int, x0 double, y0 double, x1 double, y1 double, text string")
    assert candidates.near_duplicate_lines(frame).count() == 0
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in candidates.near_duplicate_lines(frame, bare=True).collect()] == [(6.0, 16.0, 24.0, 34.0)]


def test_blocks_in_one_pass(spark):
    """Pages that go together, rows without a size, a text or a place: the same blocks as from the operators one by one, and no grouped fold."""
    r, rows = random.Random(5), []
    for page in range(6):
        for ix in range(70):
            x, y = r.randrange(0, 500, 7), r.randrange(0, 300, 6) + r.random()
            rows.append((page % 2, page, ix, float(x), y, float(x + r.randrange(5, 60)), y + r.randrange(6, 12), r.choice(["1.", "(b)", "SITE NOTES:", "BIG TITLE", " word ", None, "b. x"]), r.choice(["Some-Bold", "Plain", None]), r.choice([8.0, 10.0, 14.0, 0.0, None])))
    rows += [(7, 0, 0, 1.0, 2.0, 3.0, 4.0, "alone", None, None)]
    frame = spark.createDataFrame(rows, TOKENS)
    lined = lines.lined(frame)
    slow = blocks.block_table(blocks.group_blocks(blocks.line_table(lines.split_by_spans(lines.spans(lined))), lines.median_space(lined)))
    fast = blocks.blocks_of(frame)
    assert sorted(map(repr, slow.collect())) == sorted(map(repr, fast.collect()))
    for made in (fast, blocks.notes_columns(fast)):
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_merge_over_whole_pages(spark):
    """The surest come out ranked as surest ranks them, with no grouped fold; without a symbol, and with a null one."""
    r = random.Random(9)
    rows = [(0, p, r.choice("abc"), r.choice(["", "%", None]), r.choice([0.4, 0.6]), float(x := r.randrange(0, 90, 3)), float(y := r.randrange(0, 30, 5)), float(x + 12), float(y + 10)) for p in range(4) for _ in range(60)]
    found = spark.createDataFrame(rows, "doc_id bigint, page bigint, method string, symbol string, confidence double, x0 double, y0 double, x1 double, y1 double")
    made = candidates.merge(found, most=5)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, candidates.surest(candidates.merge(found), 5).collect()))
    assert made.count() == 20 and "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert candidates.merge(found.where("false"), most=5).count() == 0
