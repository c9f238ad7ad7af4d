"""Named queries of the library's own operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import text as T
from .operators import blocks, candidates, checks, ledger, lines, regions, spatial, store
from .plans.inputs import load, with_inputs
from .streaming import live

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "spatial_best_match"


def query(name: str, *inputs: str, sql: str | None = None):
    """Registers f(*inputs as DataFrames) and, if given, SQL in which {input} stands for an input."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[load(spark, sf_dir, i) for i in inputs])
        if sql:
            ORACLES[name] = with_inputs(sql)
        return f

    return add


def _pairs(tokens):
    """Text tokens beside OCR tokens of the same page."""
    return tokens.where("origin = 'ocr'"), tokens.where("origin = 'text'")


PAIR = "FROM {tokens} a JOIN {tokens} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.origin = 'ocr' AND b.origin = 'text'"
INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREAS = "greatest(0, (a.x1 - a.x0) * (a.y1 - a.y0)) + greatest(0, (b.x1 - b.x0) * (b.y1 - b.y0))"
#: Pairs that share a cell of 50 points.
SHARED = "floor(a.x0 / 50) <= floor(b.x1 / 50) AND floor(b.x0 / 50) <= floor(a.x1 / 50) AND floor(a.y0 / 50) <= floor(b.y1 / 50) AND floor(b.y0 / 50) <= floor(a.y1 / 50)"


@query("geometry_overlap", "tokens", sql=f"SELECT a.doc_id, a.page, a.token_ix, b.token_ix AS other_ix, round({INTER}, 6) AS shared, round({INTER} / ({AREAS} - {INTER}), 6) AS iou {PAIR} AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def _(tokens):
    met = spatial.candidates(*_pairs(tokens), G.overlaps)
    a, b = G.box(), G.box(suffix="_r")
    return met.select("doc_id", "page", "token_ix", F.col("token_ix_r").alias("other_ix"), F.round(G.intersection(a, b), 6).alias("shared"), F.round(G.iou(a, b), 6).alias("iou"))


@query("geometry_expressions", "tokens", sql="SELECT token_ix, round(greatest(0, x0 - 4), 6) AS px0, round(least(612, x1 + 4), 6) AS px1, round(degrees(atan2(y1 - y0, x1 - x0)), 6) AS angle, CASE WHEN (x0 / 612 < .15 OR x0 / 612 > .85) AND (y0 / 792 < .15 OR y0 / 792 > .85) THEN 'corner' WHEN x0 / 612 < .15 OR x0 / 612 > .85 OR y0 / 792 < .15 OR y0 / 792 > .85 THEN 'margin' WHEN x0 / 612 BETWEEN .35 AND .65 AND y0 / 792 BETWEEN .35 AND .65 THEN 'center' ELSE 'field' END AS zone FROM {tokens}")
def _(tokens):
    p = G.pad(G.box(), 4.0, 612.0, 792.0)
    return tokens.select("token_ix", F.round(p.x0, 6).alias("px0"), F.round(p.x1, 6).alias("px1"), F.round(G.line_angle(G.box()), 6).alias("angle"), G.zone_of(F.col("x0") / 612, F.col("y0") / 792).alias("zone"))


@query("geometry_rotate", "tokens", sql="SELECT token_ix, round(least(ax, bx, cx, dx), 4) AS x0, round(greatest(ax, bx, cx, dx), 4) AS x1 FROM (SELECT token_ix, (x0 - 306) * c - (y0 - 396) * s + 306 AS ax, (x0 - 306) * c - (y1 - 396) * s + 306 AS bx, (x1 - 306) * c - (y0 - 396) * s + 306 AS cx, (x1 - 306) * c - (y1 - 396) * s + 306 AS dx FROM {tokens}, (SELECT sin(radians(2)) AS s, cos(radians(2)) AS c))")
def _(tokens):
    r = G.rotate(G.box(), 2.0, 612.0, 792.0)
    return tokens.select("token_ix", F.round(r.x0, 4).alias("x0"), F.round(r.x1, 4).alias("x1"))


@query("geometry_polygon", "tokens", sql="SELECT token_ix FROM {tokens} WHERE (x0 + x1) / 2 + (y0 + y1) / 2 < 400 AND (x0 + x1) / 2 > 0 AND (y0 + y1) / 2 > 0")
def _(tokens):
    x, y = G.center(G.box())
    corner = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"))
    return tokens.where(G.in_polygon(x, y, F.array(corner(0.0, 0.0), corner(400.0, 0.0), corner(0.0, 400.0)))).select("token_ix")


@query("spatial_best_match", "tokens", sql=f"""
WITH s AS (SELECT a.page, a.token_ix, b.token_ix AS ix, {INTER} / ({AREAS} - {INTER}) AS iou, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS dx, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) AS dy {PAIR} AND {SHARED}),
i AS (SELECT page, token_ix, ix FROM s WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, token_ix ORDER BY iou DESC, ix) = 1),
c AS (SELECT page, token_ix, ix FROM s WHERE dx <= 12 AND dy <= 12 QUALIFY row_number() OVER (PARTITION BY page, token_ix ORDER BY dx + dy, ix) = 1)
SELECT t.doc_id, t.page, t.token_ix, coalesce(i.ix, c.ix, -1) AS match_ix, CASE WHEN i.ix IS NOT NULL THEN 'iou' WHEN c.ix IS NOT NULL THEN 'center' ELSE 'unmatched' END AS match_type
FROM {{tokens}} t LEFT JOIN i ON t.token_ix = i.token_ix LEFT JOIN c ON t.token_ix = c.token_ix WHERE t.origin = 'ocr'""")
def _(tokens):
    return spatial.best_match(*_pairs(tokens)).fillna(-1, "match_ix")


for _anti in (False, True):

    @query(f"spatial_{'uncovered' if _anti else 'covered'}", "tokens", sql=f"SELECT a.token_ix FROM {{tokens}} a WHERE a.origin = 'ocr' AND {'NOT' if _anti else ''} EXISTS (SELECT 1 FROM {{tokens}} b WHERE a.doc_id = b.doc_id AND a.page = b.page AND b.origin = 'text' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
    def _(tokens, anti=_anti):
        return spatial.covered(*_pairs(tokens), anti=anti).select("token_ix")


@query("spatial_best_zone", "tokens", "zones", sql=f"SELECT a.doc_id, a.page, a.token_ix, b.zone_ix FROM {{tokens}} a JOIN {{zones}} b ON a.doc_id = b.doc_id AND a.page = b.page WHERE {INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.3 QUALIFY row_number() OVER (PARTITION BY a.token_ix ORDER BY {INTER} DESC, b.zone_ix) = 1")
def _(tokens, zones):
    return spatial.best_zone(tokens, zones)


@query("spatial_nearest_digits", "tokens", sql="""
WITH d AS (SELECT a.token_ix, b.token_ix AS ix, a.x0 - b.x1 AS l, b.x0 - a.x1 AS r FROM {tokens} a JOIN {tokens} b ON a.doc_id = b.doc_id AND a.page = b.page AND regexp_matches(b.text, '^[0-9]') AND a.token_ix <> b.token_ix AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
l AS (SELECT token_ix, ix FROM d WHERE l BETWEEN 0 AND 40 QUALIFY row_number() OVER (PARTITION BY token_ix ORDER BY l, ix) = 1),
r AS (SELECT token_ix, ix FROM d WHERE r BETWEEN 0 AND 40 QUALIFY row_number() OVER (PARTITION BY token_ix ORDER BY r, ix) = 1)
SELECT t.doc_id, t.page, t.token_ix, coalesce(l.ix, -1) AS left_ix, coalesce(r.ix, -1) AS right_ix FROM {tokens} t LEFT JOIN l USING (token_ix) LEFT JOIN r USING (token_ix)""")
def _(tokens):
    return spatial.nearest_digits(tokens, tokens).fillna(-1)


@query("spatial_nms", "tokens")
def _(tokens):
    return spatial.nms(tokens, 0.3).select("doc_id", "page", "token_ix")


@query("spatial_clusters", "tokens", sql="""
WITH RECURSIVE e AS (SELECT a.token_ix AS a, b.token_ix AS b FROM {tokens} a JOIN {tokens} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.token_ix <> b.token_ix AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
r(a, b) AS (SELECT token_ix, token_ix FROM {tokens} UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, t.page, t.token_ix, min(r.b) AS cluster FROM {tokens} t JOIN r ON t.token_ix = r.a GROUP BY t.doc_id, t.page, t.token_ix""")
def _(tokens):
    return spatial.overlap_clusters(tokens)


LINE = "PARTITION BY doc_id, page, line_ix ORDER BY x0, token_ix"
NEXT = f"(SELECT *, lead(x0) OVER ({LINE}) - x1 AS gap, x0 - lag(x1) OVER ({LINE}) AS back FROM {{lined}})"
MEDIAN = f"(SELECT doc_id, page, quantile_cont(gap, 0.5) AS m FROM (SELECT doc_id, page, gap FROM {NEXT} WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY gap, token_ix) <= CASE WHEN floor(count(*) OVER (PARTITION BY doc_id, page) * 0.9) > 0 THEN floor(count(*) OVER (PARTITION BY doc_id, page) * 0.9) ELSE count(*) OVER (PARTITION BY doc_id, page) END) GROUP BY doc_id, page)"


@query("lines_build", "tokens")
def _(tokens):
    return lines.build_lines(tokens)


@query("lines_of_built", "tokens")
def _(tokens):
    return lines.spans(lines.lined(tokens), 2.0).select("doc_id", "page", "token_ix", "line_ix", "span_ix")


@query("lines_split_by_spans", "lined", sql=f"SELECT token_ix, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_ix, span_ix) - 1 AS INT) AS line_ix FROM (SELECT n.doc_id, n.page, token_ix, line_ix, sum(CASE WHEN back > 2 * coalesce(m, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY n.doc_id, n.page, line_ix ORDER BY x0, token_ix ROWS UNBOUNDED PRECEDING) AS span_ix FROM {NEXT} n LEFT JOIN {MEDIAN} m ON n.doc_id = m.doc_id AND n.page = m.page)")
def _(rows):
    return lines.split_by_spans(lines.spans(rows, 2.0)).select("token_ix", "line_ix")


@query("lines_spans", "lined", sql=f"SELECT token_ix, line_ix, CAST(coalesce(sum(CASE WHEN back > 2 * coalesce(m, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY n.doc_id, n.page, line_ix ORDER BY x0, token_ix ROWS UNBOUNDED PRECEDING), 0) AS INT) AS span_ix FROM {NEXT} n LEFT JOIN {MEDIAN} m ON n.doc_id = m.doc_id AND n.page = m.page")
def _(rows):
    return lines.spans(rows, 2.0).select("token_ix", "line_ix", "span_ix")


@query("lines_median_space", "lined", sql=f"SELECT t.doc_id, t.page, coalesce(m, 5) AS median_gap FROM (SELECT DISTINCT doc_id, page FROM {{lined}}) t LEFT JOIN {MEDIAN} m ON t.doc_id = m.doc_id AND t.page = m.page")
def _(rows):
    return lines.median_space(rows)


@query("lines_intraline_gaps", "lined", sql=f"SELECT doc_id, page, line_ix, token_ix, gap FROM {NEXT} n JOIN (SELECT doc_id, page, line_ix, quantile_cont(gap, 0.5) AS m FROM {NEXT} WHERE gap > 0 GROUP BY doc_id, page, line_ix) g USING (doc_id, page, line_ix) WHERE gap > 1.5 * m AND gap > 1")
def _(rows):
    return lines.intraline_gaps(rows, 1.5)


@query("lines_skew", "lined", sql="WITH s AS (SELECT doc_id, page, line_ix, count(*) AS weight, regr_slope(y0, (x0 + x1) / 2) AS slope FROM {lined} GROUP BY doc_id, page, line_ix HAVING count(*) >= 2), r AS (SELECT *, sum(weight) OVER (PARTITION BY doc_id, page ORDER BY slope, line_ix ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY doc_id, page) AS every FROM s WHERE slope IS NOT NULL) SELECT doc_id, page, round(greatest(-5, least(5, degrees(atan(min(slope))))), 6) AS degrees FROM r WHERE run * 2 >= every GROUP BY doc_id, page")
def _(rows):
    return lines.skew(lines.line_slopes(rows, 2)).select("doc_id", "page", F.round("degrees", 6).alias("degrees"))


@query("lines_skew_regression", "tokens", sql="SELECT doc_id, page, round(greatest(-5, least(5, degrees(atan(coalesce(regr_slope(y0, (x0 + x1) / 2), 0))))), 6) AS degrees FROM {tokens} GROUP BY doc_id, page")
def _(tokens):
    return lines.skew_by_regression(tokens).select("doc_id", "page", F.round("degrees", 6).alias("degrees"))


@query("lines_median_size", "tokens", sql="SELECT doc_id, page, quantile_cont(x1 - x0, 0.5) AS width, quantile_cont(y1 - y0, 0.5) AS height FROM {tokens} GROUP BY doc_id, page")
def _(tokens):
    return lines.median_size(tokens)


@query("lines_adjacent_numbers", "lined", sql=f"SELECT doc_id, page, line_ix, token_ix, gap FROM (SELECT *, lead(text) OVER ({LINE}) AS following FROM {NEXT}) WHERE regexp_matches(text, '^[0-9][0-9.,]*$') AND regexp_matches(following, '^[0-9][0-9.,]*$') AND gap BETWEEN 0.2 AND 20")
def _(rows):
    return lines.adjacent_numbers(rows)


@query("lines_width_anomalies", "tokens", sql="SELECT doc_id, page, token_ix, round((x1 - x0) / (length(text) * font_size * 0.55), 6) AS ratio FROM {tokens} WHERE (x1 - x0) / (length(text) * font_size * 0.55) < 0.7")
def _(tokens):
    return lines.width_anomalies(tokens).withColumn("ratio", F.round("ratio", 6))


@query("lines_symbol_fingerprints", "tokens", sql="SELECT regexp_replace(regexp_replace(text, '[0-9]+\\.?[0-9]*', 'N', 'g'), '[%°]', '', 'g') AS fingerprint, count(*) AS n, count(*) FILTER (regexp_matches(text, '[%°]')) AS with_symbol FROM {tokens} GROUP BY 1 HAVING with_symbol > 0 AND with_symbol < n")
def _(tokens):
    return lines.symbol_fingerprints(tokens)


def finding(check: str, severity: str, subject: str, *keys: str) -> str:
    named = ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in keys or ("doc_id", "page"))
    return f"SELECT '{check}' AS check_id, '{severity}' AS severity, {named}, coalesce(CAST({subject} AS VARCHAR), '') AS subject"


def missing(table: str, keys: str) -> str:
    """Ranges of whole numbers from 1 to the highest that a group lacks, as missing: islands of the numbers that aren't there."""
    return (
        f"(WITH w AS (SELECT {keys}, unnest(range(1, max(number) + 1)) AS number FROM {table} GROUP BY {keys}), l AS (SELECT * FROM w ANTI JOIN {table} t USING ({keys}, number)), "
        f"i AS (SELECT {keys}, min(number) AS low, max(number) AS high FROM (SELECT *, number - row_number() OVER (PARTITION BY {keys} ORDER BY number) AS island FROM l) GROUP BY {keys}, island) "
        f"SELECT {keys}, string_agg(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE concat(low, '-', high) END, ',' ORDER BY low) AS missing FROM i GROUP BY {keys})"
    )


COLUMN = "doc_id, page, column_ix"


@query("check_numbering", "notes", sql=f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY {COLUMN}, number ORDER BY ord) AS nth, lag(number) OVER (PARTITION BY {COLUMN} ORDER BY ord) AS before FROM {{notes}})
{finding('NOTES_DUP', 'error', 'number')} FROM d WHERE nth > 1
UNION ALL {finding('NOTES_GAP', 'warning', 'missing')} FROM {missing('{notes}', COLUMN)}
UNION ALL {finding('NOTES_ORDER', 'warning', 'number')} FROM (SELECT * FROM d WHERE number < before QUALIFY row_number() OVER (PARTITION BY {COLUMN} ORDER BY ord) = 1)""")
def _(notes):
    return checks.numbering(notes)


@query("check_note_headers", "columns", sql=f"{finding('NOTES_NO_HEADER', 'warning', 'column_ix')} FROM {{columns}} WHERE trim(coalesce(header, '')) = '' AND n_notes > 0")
def _(columns):
    return checks.columns_without_header(columns)


@query("check_note_references", "notes", sql=f"WITH r AS (SELECT doc_id, page, CAST(unnest(regexp_extract_all(text, '(?i)(?:SEE|REFER\\s+TO)\\s+NOTE\\s+#?([0-9]+)', 1)) AS BIGINT) AS number FROM {{notes}}) {finding('NOTES_XREF', 'warning', 'number')} FROM r WHERE NOT EXISTS (SELECT 1 FROM {{notes}} n WHERE n.doc_id = r.doc_id AND n.page = r.page AND n.number = r.number)")
def _(notes):
    return checks.undefined_references(notes, notes)


NAMED = "(SELECT doc_id, page, upper(trim(code)) AS code, upper(trim(meaning)) AS meaning FROM {entries})"


@query("check_abbreviations", "entries", sql=f"{finding('ABBREV_DUP', 'error', 'code')} FROM {NAMED} WHERE code <> '' GROUP BY doc_id, page, code HAVING count(DISTINCT meaning) > 1")
def _(entries):
    return checks.abbreviations(entries)


@query("check_undefined_abbreviations", "notes", "entries", sql=f"""
WITH u AS (SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(text, '\\b([A-Z]{{{{2,}}}})\\b', 1)) AS code FROM {{notes}})
{finding('ABBREV_UNDEF', 'info', 'code')} FROM u WHERE code NOT IN ({', '.join(f"'{w}'" for w in checks.COMMON_WORDS)})
AND EXISTS (SELECT 1 FROM {NAMED} e WHERE e.doc_id = u.doc_id AND e.page = u.page) AND NOT EXISTS (SELECT 1 FROM {NAMED} e WHERE e.doc_id = u.doc_id AND e.page = u.page AND e.code = u.code)""".replace("{{2,}}", "{2,}"))
def _(notes, entries):
    return checks.undefined_abbreviations(notes, entries)


BARE = "FROM {regions} r WHERE NOT EXISTS (SELECT 1 FROM {entries} e WHERE e.doc_id = r.doc_id AND e.page = r.page AND e.region_ix = r.region_ix)"


@query("check_empty_regions", "regions", "entries", sql=f"{finding('LEGEND_EMPTY', 'warning', 'region_ix')} {BARE} AND region_type = 'legend' UNION ALL {finding('ABBREV_EMPTY', 'info', 'region_ix')} {BARE} AND region_type = 'abbreviation' UNION ALL {finding('REV_EMPTY', 'info', 'region_ix')} {BARE} AND region_type = 'revision'")
def _(regions, entries):
    return checks.empty_regions(regions, entries)


@query("check_legend_headers", "regions", "entries", sql=f"{finding('LEGEND_NO_HEADER', 'info', 'region_ix')} {BARE.replace('NOT EXISTS', 'EXISTS')} AND region_type = 'legend' AND trim(coalesce(header, '')) = ''")
def _(regions, entries):
    return checks.legends_without_header(regions, entries)


@query("check_revision_dates", "revisions", sql=f"""
WITH s AS (SELECT *, lag(date) OVER g AS before, row_number() OVER g AS nth FROM {{revisions}} WHERE date IS NOT NULL WINDOW g AS (PARTITION BY doc_id, page, region_ix ORDER BY ord)),
f AS (SELECT doc_id, page, region_ix, bool_or(before <= date) AS rising FROM s WHERE nth = 2 GROUP BY doc_id, page, region_ix),
b AS (SELECT s.* FROM s JOIN f USING (doc_id, page, region_ix) WHERE CASE WHEN rising THEN date < before ELSE date > before END QUALIFY row_number() OVER (PARTITION BY doc_id, page, region_ix ORDER BY ord) = 1)
{finding('REV_DATE_ORDER', 'warning', 'date')} FROM b""")
def _(revisions):
    return checks.revision_dates(revisions)


@query("check_revision_numbers", "revisions", sql=f"{finding('REV_NO_NUMBER', 'warning', 'ord')} FROM {{revisions}} WHERE (trim(description) <> '' OR date IS NOT NULL) AND trim(number) = ''")
def _(revisions):
    return checks.revisions_without_number(revisions)


@query("check_details", "details", sql=f"{finding('STDDET_DUP', 'warning', 'code')} FROM (SELECT doc_id, page, upper(trim(sheet)) AS code FROM {{details}}) WHERE code <> '' GROUP BY doc_id, page, code HAVING count(*) > 1 UNION ALL {finding('STDDET_NO_DESC', 'warning', 'sheet')} FROM {{details}} WHERE trim(sheet) <> '' AND trim(description) = ''")
def _(details):
    return checks.union([checks.detail_duplicates(details), checks.details_without_description(details)])


@query("check_title_fields", "pages_q", "fields", sql=f"""
WITH t AS (SELECT DISTINCT doc_id, page, unnest(['sheet_number', 'date']) AS label FROM {{fields}})
{finding('TITLE_MISSING', 'warning', "''")} FROM {{pages_q}} p WHERE NOT EXISTS (SELECT 1 FROM {{fields}} f WHERE f.doc_id = p.doc_id AND f.page = p.page)
UNION ALL SELECT concat('TITLE_NO_', upper(label)), 'warning', doc_id, page, label FROM t ANTI JOIN (SELECT * FROM {{fields}} WHERE value <> '') f USING (doc_id, page, label)""")
def _(pages, fields):
    return checks.title_fields(pages, fields)


WHOLE = "(SELECT doc_id, TRY_CAST(number AS BIGINT) AS number FROM {revisions} WHERE TRY_CAST(number AS BIGINT) >= 0)"


@query("check_documents", "pages_q", "entries", "symbols", "revisions", sql=f"""
{finding('DOC_DUP_SHEET', 'error', 'code', 'doc_id')} FROM (SELECT doc_id, upper(trim(sheet)) AS code FROM {{pages_q}}) WHERE code <> '' GROUP BY doc_id, code HAVING count(*) > 1
UNION ALL {finding('DOC_ABBREV_CONFLICT', 'error', 'code', 'doc_id')} FROM {NAMED} WHERE code <> '' GROUP BY doc_id, code HAVING count(DISTINCT meaning) > 1
UNION ALL {finding('DOC_TITLE_INCONSISTENT', 'info', 'count(*) FILTER (sheet IS NULL)', 'doc_id')} FROM {{pages_q}} GROUP BY doc_id HAVING count(*) FILTER (sheet IS NULL) BETWEEN 1 AND count(*) - 1
UNION ALL {finding('DOC_LEGEND_CONFLICT', 'warning', 'symbol', 'doc_id')} FROM {{symbols}} WHERE trim(description) <> '' GROUP BY doc_id, symbol HAVING count(DISTINCT upper(trim(description))) > 1
UNION ALL {finding('DOC_REVISION_GAP', 'warning', 'missing', 'doc_id')} FROM {missing(WHOLE, 'doc_id')}
UNION ALL {finding('DOC_LOW_QUALITY', 'info', 'count(*)', 'doc_id')} FROM (SELECT *, avg(quality) OVER (PARTITION BY doc_id) AS mean, count(*) OVER (PARTITION BY doc_id) AS n FROM {{pages_q}} WHERE quality > 0) WHERE n >= 3 AND quality < 0.6 * mean GROUP BY doc_id""")
def _(pages, entries, symbols, revisions):
    return checks.document_checks(pages, entries, symbols, revisions)


@query("check_all", "notes", "pages_q", "details", sql=f"""
WITH f AS ({finding('STDDET_NO_DESC', 'warning', 'sheet')} FROM {{details}} WHERE trim(sheet) <> '' AND trim(description) = ''
UNION ALL {finding('NOTES_DUP', 'error', 'number')} FROM (SELECT * FROM {{notes}} QUALIFY row_number() OVER (PARTITION BY {COLUMN}, number ORDER BY ord) > 1))
SELECT check_id, CASE WHEN confidence < 0.6 AND severity = 'error' THEN 'warning' WHEN confidence < 0.6 AND severity = 'warning' THEN 'info' ELSE severity END AS severity, f.doc_id, f.page, subject FROM f LEFT JOIN {{pages_q}} p ON f.doc_id = p.doc_id AND f.page = p.page""")
def _(notes, pages, details):
    return checks.run_checks([checks.details_without_description(details), checks.numbering(notes).where("check_id = 'NOTES_DUP'")], pages)


LAST = "(SELECT * FROM {corrections} WHERE detection_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY corrected_at DESC, seq DESC) = 1)"


@query("store_latest_corrections", "corrections", sql="SELECT detection_id, seq, correction_type, corrected_element_type FROM {corrections} WHERE detection_id IS NOT NULL AND correction_type <> 'delete' QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY corrected_at DESC, seq DESC) = 1")
def _(corrections):
    return store.latest(corrections).select("detection_id", "seq", "correction_type", "corrected_element_type")


@query("store_corrected", "detections", "corrections", sql=f"SELECT d.detection_id, CASE WHEN c.correction_type = 'relabel' THEN c.corrected_element_type ELSE d.element_type END AS element_type FROM {{detections}} d LEFT JOIN {LAST} c USING (detection_id) WHERE c.correction_type IS NULL OR c.correction_type <> 'delete'")
def _(detections, corrections):
    return store.corrected(detections, corrections)


@query("store_uncorrected", "detections", "corrections", sql="SELECT detection_id FROM {detections} WHERE detection_id NOT IN (SELECT detection_id FROM {corrections} WHERE detection_id IS NOT NULL)")
def _(detections, corrections):
    return store.uncorrected(detections, corrections).select("detection_id")


@query("store_split", "detections", sql="SELECT example_id, label, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT detection_id AS example_id, element_type AS label, (row_number() OVER (PARTITION BY element_type ORDER BY md5(CAST(detection_id AS VARCHAR)), detection_id) - 1) / count(*) OVER (PARTITION BY element_type) AS s FROM {detections})")
def _(detections):
    return store.split(detections.selectExpr("detection_id example_id", "element_type label"))


PREDICTED = "(SELECT element_type AS actual, CASE WHEN detection_id % 5 = 0 THEN 'legend' WHEN detection_id % 11 = 0 THEN 'other' ELSE element_type END AS predicted FROM {detections})"
METRICS = f"(WITH p AS {PREDICTED}, l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p), c AS (SELECT label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS said, count(*) FILTER (actual = label AND predicted = label) AS hit FROM l, p GROUP BY label), r AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c) SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, support FROM r)"


def _predicted(detections):
    return detections.selectExpr("element_type actual", "case when detection_id % 5 = 0 then 'legend' when detection_id % 11 = 0 then 'other' else element_type end predicted")


@query("metrics_by_class", "detections", sql=f"SELECT * FROM {METRICS}")
def _(detections):
    return store.class_metrics(_predicted(detections))


@query("metrics_compare_runs", "detections", sql=f"SELECT label, round(1 - f1, 4) * (label <> 'other')::INT + CASE WHEN label = 'other' THEN round(-f1, 4) ELSE 0 END AS delta, CASE WHEN label <> 'other' AND round(1 - f1, 4) > 0.005 THEN 'better' ELSE 'same' END AS verdict FROM {METRICS}")
def _(detections):
    return store.compare_runs(store.class_metrics(_predicted(detections)), store.class_metrics(detections.selectExpr("element_type actual", "element_type predicted")))


@query("stats_methods", "outcomes", sql="SELECT method, count(*) AS flagged, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, round(count(*) FILTER (outcome = 'hit') / count(*), 4) AS hit_rate FROM (SELECT unnest([m1, m2]) AS method, outcome FROM {outcomes}) GROUP BY method")
def _(outcomes):
    return store.method_stats(outcomes.selectExpr("array(m1, m2) trigger_methods", "outcome"))


@query("stats_adaptive_confidence", "outcomes", sql="WITH s AS (SELECT method, count(*) AS flagged, count(*) FILTER (outcome = 'hit') AS hits FROM (SELECT unnest([m1, m2]) AS method, outcome FROM {outcomes}) GROUP BY method) SELECT method, CASE WHEN flagged < 5 THEN 0.5 ELSE greatest(0.1, least(0.95, round((hits + 1) / (flagged + 2), 4))) END::DOUBLE AS confidence FROM s")
def _(outcomes):
    return store.method_stats(outcomes.selectExpr("array(m1, m2) trigger_methods", "outcome")).select("method", store.adaptive_confidence(F.lit(0.5), F.col("flagged"), F.col("hits")).alias("confidence"))


@query("stats_merge_counters", "outcomes", sql="SELECT m1 AS method, count(*) AS flagged, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses FROM {outcomes} GROUP BY m1")
def _(outcomes):
    run = lambda r: store.method_stats(outcomes.where(f"event_id % 2 = {r}").selectExpr("array(m1) trigger_methods", "outcome")).drop("hit_rate")
    return store.merge_counters(run(0), run(1))


@query("stats_page_uncertainty", "detections", sql="SELECT doc_id, page, round(avg(1 - confidence), 9) AS uncertainty, count(*) AS n FROM {detections} GROUP BY doc_id, page")
def _(detections):
    return store.page_uncertainty(detections).withColumn("uncertainty", F.round("uncertainty", 9))


@query("stats_calibration", "detections", sql="WITH b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN detection_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS a FROM {detections} GROUP BY 1) SELECT bin, n, round(c, 9) AS confidence, round(a, 9) AS accuracy, round(n / sum(n) OVER () * abs(c - a), 9) AS error FROM b")
def _(detections):
    out = store.calibration(detections.selectExpr("confidence", "cast(detection_id % 3 = 0 as int) correct"))
    return out.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("confidence", "accuracy", "error")])


@query("drift_fit", "embeddings", sql="SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99 FROM (SELECT unnest(range(len(embedding)))::INT AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM {embeddings}) GROUP BY feature")
def _(embeddings):
    return store.drift_fit(embeddings.selectExpr("transform(embedding, x -> cast(x as double)) features")).select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p1", "p99")])


@query("drift_check", "embeddings", sql="WITH l AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM {embeddings}), f AS (SELECT feature, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM l GROUP BY feature) SELECT id, round(avg(CASE WHEN v < p1 OR v > p99 THEN 1.0 ELSE 0.0 END), 9) AS fraction, avg(CASE WHEN v < p1 OR v > p99 THEN 1.0 ELSE 0.0 END) >= 0.05 AS drifted FROM l JOIN f USING (feature) GROUP BY id")
def _(embeddings):
    samples = embeddings.selectExpr("vec_id id", "transform(embedding, x -> cast(x as double)) features")
    return store.drift_check(samples, store.drift_fit(samples), 0.05).withColumn("fraction", F.round("fraction", 9))


@query("search_cosine", "embeddings", sql="WITH q AS (SELECT [CAST(0.25 AS DOUBLE) * (i % 3 + 1) FOR i IN range(64)] AS q), s AS (SELECT vec_id AS id, round(greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)), 4) AS score FROM {embeddings}, q WHERE label < 5) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM s ORDER BY score DESC, id LIMIT 10")
def _(embeddings):
    return store.cosine_search(embeddings.selectExpr("vec_id id", "embedding", "label"), [0.25 * (i % 3 + 1) for i in range(64)], 10, F.col("label") < 5)


@query("store_latest_run", "detections", sql="WITH r AS (SELECT doc_id, run_id FROM {detections} WHERE run_id NOT LIKE 'manual%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, run_id DESC) = 1) SELECT d.detection_id, d.run_id FROM {detections} d LEFT JOIN r ON d.doc_id = r.doc_id WHERE d.run_id LIKE 'manual%' OR d.run_id = r.run_id")
def _(detections):
    return store.latest_run(detections).select("detection_id", "run_id")


@query("store_next_page", "detections", "corrections", sql="WITH o AS (SELECT DISTINCT doc_id, page FROM {detections} WHERE detection_id NOT IN (SELECT detection_id FROM {corrections} WHERE detection_id IS NOT NULL)) SELECT doc_id, page, round(avg(1 - confidence), 9) AS uncertainty, count(*) AS n FROM {detections} JOIN o USING (doc_id, page) GROUP BY doc_id, page ORDER BY uncertainty DESC, doc_id, page LIMIT 1")
def _(detections, corrections):
    return store.next_page(detections, corrections).withColumn("uncertainty", F.round("uncertainty", 9))


@query("store_page_type_counts", "detections", sql="SELECT page, element_type, count(*) AS n FROM {detections} GROUP BY page, element_type")
def _(detections):
    return detections.groupBy("page", "element_type").agg(F.count("*").alias("n"))


@query("cost_of_calls", "calls", sql="SELECT model, round(sum(CASE model WHEN 'click' THEN (input_tokens * 2 + output_tokens * 8) / 1e6 WHEN 'view' THEN (input_tokens + output_tokens * 4) / 1e6 ELSE 0 END), 6) AS cost FROM {calls} GROUP BY model")
def _(calls):
    prices = calls.sparkSession.createDataFrame([("click", 2.0, 8.0), ("view", 1.0, 4.0)], "model string, price_in double, price_out double")
    return store.estimate_cost(calls, prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("text_expressions", "tokens", sql="SELECT token_ix, regexp_matches(text, '^[0-9][0-9.,]*$') AS digits, CAST(greatest(1, floor(length(text) / 4)) AS INT) AS tokens, substr(sha256(concat(CAST(page AS VARCHAR), ':', text)), 1, 16) AS hash, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, length(text) > 0 AND right(text, 1) NOT IN ('.', '!', '?', ':', ';') AS incomplete, CASE WHEN confidence < 0.6 THEN 'warning' ELSE 'error' END AS severity FROM {tokens}")
def _(tokens):
    t = F.col("text")
    return tokens.select("token_ix", T.is_digits(t).alias("digits"), T.token_estimate(t).alias("tokens"), T.content_hash(F.col("page"), t).alias("hash"), T.slug(t).alias("slug"), T.ends_incomplete(t).alias("incomplete"), T.severity(F.lit("error"), F.col("confidence")).alias("severity"))


@query("text_dates", "orders", sql="SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM {orders}")
def _(orders):
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.concat(F.lit("REV "), F.date_format("o_orderdate", "MM-dd-yyyy")))
    return orders.select("o_orderkey", T.parse_date(shown).cast("string").alias("parsed"))


@query("stream_windowed_counts", "events", sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")
def _(events):
    return live.windowed_counts(events).withColumn("total", F.round("total", 4))


GONE = "(SELECT d.* FROM {detections} d JOIN (SELECT doc_id, run_id FROM {detections} WHERE run_id NOT ILIKE 'manual%' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, run_id DESC) = 1) k ON d.doc_id = k.doc_id WHERE d.run_id <> k.run_id AND d.run_id NOT ILIKE 'manual%')"


@query("ledger_stale", "detections", sql=f"SELECT detection_id, run_id FROM {GONE}")
def _(detections):
    return ledger.stale(detections).select("detection_id", "run_id")


def _purged(name):
    def run(detections, corrections, groups, members):
        return ledger.purge({"detections": detections, "corrections": corrections, "box_groups": groups, "box_group_members": members}, ledger.stale(detections))[name]

    return run


PURGED = ("detections", "corrections", "groups", "members")
query("ledger_purge_detections", *PURGED, sql=f"SELECT detection_id FROM {{detections}} WHERE detection_id NOT IN (SELECT detection_id FROM {GONE})")(lambda *t: _purged("detections")(*t).select("detection_id"))
query("ledger_purge_corrections", *PURGED, sql=f"SELECT seq, CASE WHEN detection_id IN (SELECT detection_id FROM {GONE}) THEN NULL ELSE detection_id END AS detection_id, correction_type FROM {{corrections}}")(lambda *t: _purged("corrections")(*t).select("seq", "detection_id", "correction_type"))
query("ledger_purge_members", *PURGED, sql=f"SELECT group_id, detection_id FROM {{members}} WHERE detection_id NOT IN (SELECT detection_id FROM {GONE})")(lambda *t: _purged("box_group_members")(*t).select("group_id", "detection_id"))
query("ledger_purge_groups", *PURGED, sql=f"SELECT group_id, root_detection_id FROM {{groups}} WHERE root_detection_id NOT IN (SELECT detection_id FROM {GONE}) AND group_id IN (SELECT group_id FROM {{members}} WHERE detection_id NOT IN (SELECT detection_id FROM {GONE}))")(lambda *t: _purged("box_groups")(*t).select("group_id", "root_detection_id"))


@query("ledger_accept", "detections", "members", sql="SELECT detection_id, doc_id, page, 'accept' AS correction_type, element_type AS original_element_type, element_type AS corrected_element_type, x0 AS corr_x0, y0 AS corr_y0, x1 AS corr_x1, y1 AS corr_y1 FROM {detections}")
def _(detections, members):
    return ledger.accept(detections, members)


@query("ledger_update", "detections", "corrections", sql=f"SELECT d.detection_id, coalesce(c.corrected_element_type, d.element_type) AS element_type, CASE WHEN c.detection_id IS NOT NULL THEN 1.0 ELSE d.confidence END AS confidence FROM {{detections}} d LEFT JOIN {LAST} c USING (detection_id)")
def _(detections, corrections):
    changes = store.latest(corrections, keep_deleted=True).select("detection_id", F.col("corrected_element_type").alias("element_type"), F.lit(1.0).alias("confidence"))
    return ledger.update(detections, changes, "detection_id").select("detection_id", "element_type", "confidence")


@query("ledger_upsert_images", "images", sql="SELECT doc_id, page, run_id, path FROM {images} QUALIFY row_number() OVER (PARTITION BY doc_id, page, run_id ORDER BY created_at DESC, detection_id DESC) = 1")
def _(images):
    rows = images.select("doc_id", "page", "run_id", "created_at", "detection_id", "path")
    return ledger.upsert(rows.where("1 = 0"), rows, "doc_id", "page", "run_id").select("doc_id", "page", "run_id", "path")


@query("ledger_page_images", "images", sql="SELECT doc_id, page, path FROM {images} QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY created_at DESC, detection_id DESC) = 1")
def _(images):
    return ledger.newest_by(images.select("doc_id", "page", "created_at", "detection_id", "path"), "created_at", "doc_id", "page").select("doc_id", "page", "path")


@query("ledger_dismiss", "corrections", sql="SELECT detection_id, max(seq) AS seq FROM {corrections} WHERE detection_id IS NOT NULL GROUP BY detection_id")
def _(corrections):
    rows = corrections.where("detection_id is not null").select("detection_id", "seq")
    return ledger.dismiss(rows.where("1 = 0"), rows)


@query("ledger_undismiss", "members", "corrections", sql="SELECT group_id, detection_id FROM {members} WHERE detection_id NOT IN (SELECT detection_id FROM {corrections} WHERE detection_id IS NOT NULL)")
def _(members, corrections):
    return ledger.undismiss(members, corrections.where("detection_id is not null")).select("group_id", "detection_id")


@query("ledger_remove_members", "groups", "members", "corrections", sql="WITH r AS (SELECT m.* FROM {members} m WHERE detection_id IN (SELECT detection_id FROM {corrections})), g AS (SELECT * FROM {groups} WHERE (group_id, root_detection_id) NOT IN (SELECT group_id, detection_id FROM r)) SELECT group_id, detection_id FROM {members} WHERE (group_id, detection_id) NOT IN (SELECT group_id, detection_id FROM r) AND group_id IN (SELECT group_id FROM g)")
def _(groups, members, corrections):
    rows = members.join(corrections.select("detection_id").distinct(), "detection_id", "left_semi")
    return ledger.remove_from_groups(groups, members, rows)[1].select("group_id", "detection_id")


@query("ledger_create_groups", "groups", "members", sql="SELECT group_id, root_detection_id AS detection_id FROM {groups}")
def _(groups, members):
    return ledger.create_group(groups.where("1 = 0"), members.where("1 = 0"), groups)[1].select("group_id", "detection_id")


@query("ledger_groups", "groups", "members", sql="SELECT group_id, root_detection_id, string_agg(CAST(detection_id AS VARCHAR), ',' ORDER BY detection_id) AS members FROM {groups} JOIN {members} USING (group_id) GROUP BY group_id, root_detection_id")
def _(groups, members):
    return ledger.groups_with_members(groups, members).withColumn("members", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))))


@query("ledger_groups_of", "groups", "members", sql="SELECT group_id, detection_id, root_detection_id FROM {members} JOIN {groups} USING (group_id)")
def _(groups, members):
    return ledger.groups_of(groups, members)


@query("ledger_settled_outcomes", "outcomes", sql="SELECT event_id, outcome FROM {outcomes} WHERE outcome IN ('hit', 'miss')")
def _(outcomes):
    return ledger.settled_outcomes(outcomes).select("event_id", "outcome")


@query("ledger_reset", "detections", "corrections", "images", sql="SELECT 'images' AS name, count(*) AS n FROM {images} UNION ALL SELECT 'detections', 0 UNION ALL SELECT 'corrections', 0")
def _(detections, corrections, images):
    return ledger.counts(ledger.reset({"images": images, "detections": detections, "corrections": corrections}))


@query("report_overview", "detections", "corrections", sql="SELECT (SELECT count(DISTINCT doc_id) FROM {detections}) AS documents, (SELECT count(*) FROM {detections}) AS detections, (SELECT CAST(max(created_at) AS VARCHAR) FROM {detections}) AS last_detection_at, (SELECT count(*) FROM {corrections}) AS corrections, (SELECT max(corrected_at) FROM {corrections}) AS last_correction_at")
def _(detections, corrections):
    return ledger.overview(detections, corrections).withColumn("last_detection_at", F.col("last_detection_at").cast("string"))


@query("report_type_breakdown", "detections", sql="SELECT element_type, count(*) AS n FROM {detections} GROUP BY element_type")
def _(detections):
    return ledger.breakdown(detections, "element_type")


@query("report_correction_breakdown", "corrections", sql="SELECT correction_type, count(*) AS n FROM {corrections} GROUP BY correction_type")
def _(corrections):
    return ledger.breakdown(corrections, "correction_type")


@query("report_page_types", "detections", sql="SELECT doc_id, run_id, page, element_type, count(*) AS n FROM {detections} GROUP BY ALL")
def _(detections):
    return ledger.breakdown(detections, "doc_id", "run_id", "page", "element_type")


@query("report_documents", "detections", "corrections", sql="SELECT d.doc_id, d.n AS detections, coalesce(c.n, 0) AS corrections, d.runs, greatest(d.at, coalesce(c.at, d.at)) AS last_activity FROM (SELECT doc_id, count(*) AS n, count(DISTINCT run_id) FILTER (run_id NOT ILIKE 'manual%') AS runs, CAST(max(created_at) AS TIMESTAMP) AS at FROM {detections} GROUP BY doc_id) d LEFT JOIN (SELECT doc_id, count(*) AS n, max(corrected_at) AS at FROM {corrections} JOIN {detections} USING (detection_id) GROUP BY doc_id) c USING (doc_id)")
def _(detections, corrections):
    return ledger.document_summary(detections, corrections)


@query("report_run_ids", "detections", sql="SELECT doc_id, run_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY max(created_at) DESC, run_id DESC) AS INT) AS place FROM {detections} WHERE run_id NOT ILIKE 'manual%' GROUP BY doc_id, run_id")
def _(detections):
    return ledger.run_ids(detections)


@query("report_recent_corrections", "corrections", sql="SELECT seq, correction_type FROM {corrections} ORDER BY corrected_at DESC, seq DESC LIMIT 25")
def _(corrections):
    return ledger.recent(corrections, "corrected_at", "seq", 25).select("seq", "correction_type")


@query("report_corrections_since", "events", "corrections", sql="SELECT count(*) AS n FROM {corrections} WHERE corrected_at > TIMESTAMP '2024-01-10 00:00:00'")
def _(events, corrections):
    return ledger.since(corrections, "corrected_at", "2024-01-10 00:00:00")


@query("report_page_extent", "detections", sql="SELECT doc_id, page, CASE WHEN max(x1) > 0 THEN max(x1) ELSE 2448 END::DOUBLE AS width, CASE WHEN max(y1) > 0 THEN max(y1) ELSE 1584 END::DOUBLE AS height FROM {detections} GROUP BY doc_id, page")
def _(detections):
    return ledger.page_extent(detections)


@query("report_outcome_counts", "outcomes", sql="SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) AS total FROM {outcomes}")
def _(outcomes):
    return ledger.outcome_counts(outcomes)


@query("report_training_history", "training", sql="SELECT run_id, trained_at FROM {training} ORDER BY trained_at DESC, run_id DESC LIMIT 20")
def _(training):
    return ledger.recent(training, "trained_at", "run_id", 20).select("run_id", "trained_at")


@query("report_experiments", "training", sql="SELECT run_id, f1_weighted FROM {training} ORDER BY f1_weighted DESC, run_id DESC LIMIT 10")
def _(training):
    return ledger.recent(training, "f1_weighted", "run_id", 10).select("run_id", "f1_weighted")


@query("report_table_counts", "detections", "corrections", "groups", "members", sql="SELECT 'detections' AS name, count(*) AS n FROM {detections} UNION ALL SELECT 'corrections', count(*) FROM {corrections} UNION ALL SELECT 'groups', count(*) FROM {groups} UNION ALL SELECT 'members', count(*) FROM {members}")
def _(detections, corrections, groups, members):
    return ledger.counts({"detections": detections, "corrections": corrections, "groups": groups, "members": members})


@query("metrics_summary", "detections", sql=f"SELECT round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM {METRICS}")
def _(detections):
    return ledger.summary_metrics(store.class_metrics(_predicted(detections)))


@query("metrics_confusion", "detections", sql=f"WITH p AS {PREDICTED}, l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p) SELECT a.label AS actual, b.label AS predicted, (SELECT count(*) FROM p WHERE p.actual = a.label AND p.predicted = b.label) AS n FROM l a, l b")
def _(detections):
    return ledger.confusion(_predicted(detections))


@query("metrics_symbols", "outcomes", sql="WITH f AS (SELECT m1 AS symbol, count(*) AS n FROM {outcomes} GROUP BY 1), t AS (SELECT m2 AS symbol, count(*) AS n FROM {outcomes} GROUP BY 1 UNION ALL SELECT m1, count(*) FILTER (outcome = 'hit') FROM {outcomes} GROUP BY 1) SELECT symbol, least(coalesce(f.n, 0), coalesce(t.n, 0)) AS hits, coalesce(f.n, 0) AS found, coalesce(t.n, 0) AS wanted FROM f FULL JOIN t USING (symbol)")
def _(outcomes):
    truth = outcomes.select(F.col("m2").alias("symbol")).unionAll(outcomes.where("outcome = 'hit'").select(F.col("m1").alias("symbol")))
    return ledger.symbol_scores(outcomes.select(F.col("m1").alias("symbol")), truth)


@query("stats_producers", "outcomes", sql="WITH s AS (SELECT m2 AS producer, m1 AS method, count(*) AS flagged, count(*) FILTER (outcome = 'hit') AS hits FROM {outcomes} GROUP BY 1, 2) SELECT producer, method, CASE WHEN flagged < 3 THEN 0.5 ELSE greatest(0.1, least(0.95, round((hits + 1) / (flagged + 2), 4))) END::DOUBLE AS confidence FROM s")
def _(outcomes):
    return ledger.producer_confidence(outcomes.selectExpr("m2 producer", "m1 method", "outcome"))


@query("drift_pages", "embeddings", sql="SELECT label AS page, round(avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS share, avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS drifted FROM {embeddings} GROUP BY label")
def _(embeddings):
    return ledger.page_drift(embeddings.selectExpr("label page", "vec_id % 3 = 0 drifted")).withColumn("share", F.round("share", 9))


@query("report_evaluation", "outcomes", sql="SELECT m1 AS difficulty, count(*) AS n, round(avg(event_id % 7), 9) AS score, round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END), 9) AS passed FROM {outcomes} GROUP BY m1")
def _(outcomes):
    out = ledger.evaluation_summary(outcomes.selectExpr("m1 difficulty", "event_id % 7 score", "outcome = 'hit' passed"))
    return out.select("difficulty", "n", F.round("score", 9).alias("score"), F.round("passed", 9).alias("passed"))


@query("entities_distinct", "entities", sql="SELECT event_id, page, kind, value FROM {entities} QUALIFY row_number() OVER (PARTITION BY kind, lower(value), page ORDER BY event_id) = 1")
def _(entities):
    return ledger.first_of(entities, "event_id", "kind", F.lower("value"), "page")


@query("entities_counts", "entities", sql="SELECT kind, count(*) AS n FROM {entities} GROUP BY kind")
def _(entities):
    return ledger.breakdown(entities, "kind")


IN_ZONE = "FROM {tokens} a JOIN {zones} b ON a.doc_id = b.doc_id AND a.page = b.page"


@query("spatial_enclosing_rect", "tokens", "zones", sql=f"SELECT a.doc_id, a.page, a.token_ix, min(b.zone_ix) AS zone_ix {IN_ZONE} WHERE b.x1 - b.x0 > 100 AND b.y1 - b.y0 > 50 AND b.x0 <= a.x0 + 20 AND b.y0 <= a.y0 + 20 AND b.x1 >= a.x1 - 20 AND b.y1 >= a.y1 - 20 GROUP BY a.doc_id, a.page, a.token_ix")
def _(tokens, zones):
    return spatial.enclosing_rect(tokens, zones)


@query("spatial_symbols_in", "tokens", "zones", sql=f"SELECT a.doc_id, a.page, b.zone_ix, a.token_ix {IN_ZONE} WHERE a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.x1 - a.x0 <= 50 AND a.y1 - a.y0 <= 50")
def _(tokens, zones):
    return spatial.symbols_in(tokens, zones)


@query("spatial_boxes_in", "tokens", "zones", sql=f"SELECT a.doc_id, a.page, b.zone_ix, a.token_ix {IN_ZONE} WHERE NOT (a.x1 < b.x0 OR a.x0 > b.x1 OR a.y1 < b.y0 OR a.y0 > b.y1)")
def _(tokens, zones):
    return spatial.boxes_in(tokens, zones)


@query("spatial_center_in", "tokens", "zones", sql=f"SELECT a.doc_id, a.page, b.zone_ix, a.token_ix {IN_ZONE} WHERE (a.x0 + a.x1) / 2 BETWEEN b.x0 - 4 AND b.x1 + 4 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 4 AND b.y1 + 4")
def _(tokens, zones):
    return spatial.center_in(tokens, zones)


@query("spatial_line_neighbours", "tokens", sql=f"SELECT a.doc_id, a.page, a.token_ix, b.token_ix AS neighbour_ix, CAST(row_number() OVER (PARTITION BY a.token_ix ORDER BY b.x0, b.token_ix) AS INT) AS place {PAIR} WHERE abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(3, (a.y1 - a.y0) * 0.6) AND b.x1 >= a.x0 - 60 AND b.x0 <= a.x1 + 60")
def _(tokens):
    return spatial.line_neighbours(tokens.where("origin = 'ocr'"), tokens, 60.0)


@query("spatial_pair_symbols", "tokens")
def _(tokens):
    symbols = tokens.where("origin = 'ocr'").withColumnRenamed("token_ix", "symbol_ix")
    return spatial.pair_symbols(symbols, tokens.where("origin = 'text'").withColumnRenamed("token_ix", "row_ix"))


@query("lines_char_width", "tokens", sql="SELECT doc_id, page, round(quantile_cont((x1 - x0) / length(text), 0.5), 6) AS char_width FROM {tokens} WHERE length(text) > 0 AND x1 > x0 GROUP BY doc_id, page")
def _(tokens):
    return lines.char_width(tokens).withColumn("char_width", F.round("char_width", 6))


@query("text_digit_groups", "tokens", sql="SELECT token_ix, length(text) > 0 AND (regexp_matches(text, '^[0-9]') OR length(regexp_replace(text, '[^0-9.]', '', 'g')) >= length(text) * 0.5) AS digits FROM {tokens}")
def _(tokens):
    return tokens.select("token_ix", T.is_digit_group(F.col("text")).alias("digits"))


ALONG = "PARTITION BY doc_id, page, line_ix"
SIDE = f"""(SELECT *, nx0 - x1 AS gap, x0 - px1 AS back, quantile_cont(CASE WHEN nx0 - x1 > 0 THEN nx0 - x1 END, 0.5) OVER ({ALONG}) AS space
FROM (SELECT doc_id, page, line_ix, token_ix, x0, y0, x1, y1, trim(text) AS t, fontname, font_size, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1, lead(trim(text)) OVER w AS nt, lead(fontname) OVER w AS nf, lead(font_size) OVER w AS ns, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(trim(text)) OVER w AS pt,
bool_or(contains(text, '@')) OVER ({ALONG}) AS with_at, bool_or(contains(text, '#')) OVER ({ALONG}) AS with_hash, bool_or(upper(trim(text)) IN ('"', '\'\'', 'MM', 'CM', 'M', 'IN', 'FT', 'INCH', 'INCHES', 'FEET') OR (regexp_matches(text, '["\'\']') AND regexp_matches(text, '[0-9]'))) OVER ({ALONG}) AS united,
count(*) FILTER (regexp_matches(trim(text), '^[0-9][0-9.,]*$')) OVER ({ALONG}) AS numbers FROM {{marked}} WINDOW w AS ({ALONG} ORDER BY x0, y0, token_ix)))""".replace("\\'\\'", "''")


def place(method: str, symbol: str, confidence: float, x0: str, y0: str, x1: str, y1: str, rest: str) -> str:
    return f"SELECT doc_id, page, '{method}' AS method, {symbol} AS symbol, CAST({confidence} AS DOUBLE) AS confidence, greatest(0, {x0} - 4) AS x0, greatest(0, {y0} - 4) AS y0, least(612, {x1} + 4) AS x1, least(792, {y1} + 4) AS y1 {rest}"


def pair(method: str, symbol: str, confidence: float, where: str, least: float = 0, side: str = "n") -> str:
    left, right = ("x1", "nx0") if side == "n" else ("px1", "x0")
    x0, x1 = (f"(CASE WHEN {right} - {left} < {least} THEN ({left} + {right}) / 2 {sign} 3 ELSE {end} END)" for sign, end in (("-", left), ("+", right)))
    return place(method, symbol, confidence, x0, f"least(y0, {side}y0)", x1, f"greatest(y1, {side}y1)", f"FROM {SIDE} WHERE {where}")


DIGIT, DIGITS = "regexp_matches({}, '[0-9]')", "regexp_matches({}, '^[0-9][0-9.,]*$')"
WIDE = "gap > 2 * space AND gap > 1"
ASKED = "(CASE WHEN upper(t) IN ('ANGLE', 'BEND', 'DEG', 'SLOPE', 'TYP', 'TYPICAL') THEN '°' WHEN upper(t) IN ('ELEV', 'EL', 'TOL', 'TOLERANCE') THEN '±' WHEN upper(t) IN ('DIA', 'DIAM', 'DIAMETER') THEN 'Ø' END)"
BEFORE = "(CASE WHEN upper(nt) IN ('TYP', 'TYP.', 'TYP)') THEN '°' WHEN upper(nt) IN ('DIA', 'DIAM', 'DIAM.', 'DIAMETER') THEN 'Ø' WHEN upper(nt) IN ('TOL', 'TOLERANCE') THEN '±' END)"
WITH = "(CASE WHEN upper(t) IN ('OC', 'O.C.', 'O.C') AND NOT with_at THEN '@' WHEN upper(t) IN ('BAR', 'REBAR') AND NOT with_hash THEN '#' END)"
ALONG_SQL = {
    "intraline_gap": pair("intraline_gap", "''", 0.6, WIDE),
    "baseline_style_gap": pair("baseline_style_gap", "''", 0.7, f"{WIDE} AND fontname = nf AND fontname <> '' AND least(font_size, ns) / greatest(font_size, ns) >= 0.85"),
    "template_adjacency": pair("template_adjacency", BEFORE, 0.85, f"{DIGIT.format('t')} AND {BEFORE} IS NOT NULL AND gap >= 0.5") + " UNION ALL " + pair("template_adjacency", "'Ø'", 0.8, f"upper(t) IN ('DIA', 'DIAM', 'DIAMETER') AND {DIGIT.format('nt')} AND gap >= 0.5"),
    "regex_digit_pattern": pair("regex_digit_pattern", "CASE WHEN contains(t, '.') AND contains(nt, '.') THEN '±' ELSE '×' END", 0.55, f"{DIGITS.format('t')} AND {DIGITS.format('nt')} AND gap >= 1") + " UNION ALL " + pair("regex_digit_pattern", "'\"'", 0.5, f"{DIGIT.format('t')} AND regexp_matches(nt, '[0-9]+/[0-9]+') AND gap > 1"),
    "impossible_sequence": pair("impossible_sequence", "''", 0.5, f"{DIGITS.format('t')} AND {DIGITS.format('nt')} AND gap BETWEEN 0.2 AND 20", 2),
    "vocab_trigger": pair("vocab_trigger", ASKED, 0.65, f"{ASKED} IS NOT NULL AND {DIGIT.format('pt')} AND back >= 0.5", 1, "p") + " UNION ALL " + pair("vocab_trigger", ASKED, 0.65, f"{ASKED} IS NOT NULL AND {DIGIT.format('nt')} AND gap >= 0.5 AND NOT coalesce({DIGIT.format('pt')} AND back >= 0.5, false)", 1),
    "keyword_cooccurrence": pair("keyword_cooccurrence", WITH, 0.6, f"{WITH} IS NOT NULL AND {DIGIT.format('pt')}", 1, "p") + " UNION ALL " + pair("keyword_cooccurrence", WITH, 0.6, f"{WITH} IS NOT NULL AND {DIGIT.format('nt')} AND NOT coalesce({DIGIT.format('pt')}, false)", 1),
    "semantic_no_units": place("semantic_no_units", "'\"'", 0.4, "x1", "y0", "x1 + 6", "y1", f"FROM {SIDE} WHERE {DIGITS.format('t')} AND numbers >= 2 AND NOT united"),
}


def along(method: str):
    @query(f"candidates_{method}", "marked", sql=ALONG_SQL[method])
    def _(rows):
        return candidates.along_lines(rows, (method,))


for _method in candidates.LINE_METHODS:
    along(_method)


@query("candidates_along_lines", "marked", sql=" UNION ALL ".join(ALONG_SQL.values()))
def _(rows):
    return candidates.along_lines(rows)


NO_TEXT = "(trim(text) = '' OR contains(text, '\ufffd') OR starts_with(trim(text), '(cid:'))"


@query("candidates_unread_tokens", "marked", sql=place("placeholder_token", "''", 0.85, "x0", "y0", "x1", "y1", f"FROM {{marked}} WHERE {NO_TEXT} AND x1 - x0 >= 0.5 AND y1 - y0 >= 0.5"))
def _(rows):
    return candidates.unread_tokens(rows)


FAILED = "(text = '' OR starts_with(text, '(cid:'))"


@query("candidates_unread_chars", "chars", sql=place("x", "''", 0.9, "x0", "y0", "x1", "y1", f"FROM {{chars}} WHERE {FAILED} AND x1 - x0 >= 0.5 AND y1 - y0 >= 0.5").replace("'x' AS method", "CASE WHEN text = '' THEN 'char_encoding_failure' ELSE 'unmapped_glyph' END AS method"))
def _(chars):
    return candidates.unread_chars(chars)


@query("candidates_narrow_tokens", "marked", sql=place("token_width_anomaly", "''", 0.45, "x0", "y0", "x1", "y1", "FROM {marked} WHERE trim(text) <> '' AND font_size > 0 AND (x1 - x0) / (length(text) * font_size * 0.55) < 0.7"))
def _(rows):
    return candidates.narrow_tokens(rows)


@query("candidates_bad_fonts", "marked", "chars", sql=place("font_subset_correlation", "''", 0.5, "x0", "y0", "x1", "y1", f"FROM {SIDE} s WHERE ({DIGIT.format('pt')} OR {DIGIT.format('nt')}) AND EXISTS (SELECT 1 FROM (SELECT doc_id, page, fontname FROM {{chars}} GROUP BY doc_id, page, fontname HAVING count(*) FILTER ({FAILED}) >= 3 AND count(*) FILTER ({FAILED}) > 0.05 * count(*)) f WHERE f.doc_id = s.doc_id AND f.page = s.page AND f.fontname = s.fontname)"))
def _(rows, chars):
    return candidates.bad_fonts(rows, chars)


MARKS = "regexp_matches(text, '[%/°±Ø×''\"#@⌀]')"


@query("candidates_repeated_phrases", "marked", sql=f"""
WITH m AS (SELECT *, regexp_matches(text, '[0-9]') AS number, sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line_ix ORDER BY x0, y0, token_ix ROWS UNBOUNDED PRECEDING) AS run, bool_or({MARKS}) OVER ({ALONG}) AS marks FROM {{marked}}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_ix, run ORDER BY x0, y0, token_ix) AS nth FROM m WHERE number),
r AS (SELECT doc_id, page, line_ix, run, any_value(marks) AS marks, string_agg(trim(text), ' ' ORDER BY nth) AS phrase, max(CASE WHEN nth = 1 THEN x1 END) AS ax, max(CASE WHEN nth = 2 THEN x0 END) AS bx, min(CASE WHEN nth <= 2 THEN y0 END) AS top, max(CASE WHEN nth <= 2 THEN y1 END) AS low FROM n GROUP BY doc_id, page, line_ix, run HAVING count(*) >= 2),
c AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (marks) OVER g AS n_with FROM r WINDOW g AS (PARTITION BY doc_id, page, phrase))
{place("cross_ref_phrase", "''", 0.75, "(CASE WHEN bx - ax < 1 THEN (ax + bx) / 2 - 3 ELSE ax END)", "top", "(CASE WHEN bx - ax < 1 THEN (ax + bx) / 2 + 3 ELSE bx END)", "low", "FROM c WHERE n_with > 0 AND n_with < n AND NOT marks")}""")
def _(rows):
    return candidates.repeated_phrases(rows)


@query("candidates_near_duplicate_lines", "marked", sql=f"""
WITH s AS (SELECT *, regexp_replace(regexp_replace(t, '[0-9]+\\.?[0-9]*', 'N', 'g'), '[%/°±Ø×''\"#@⌀]', '', 'g') AS norm, {MARKS.replace('text', 't')} AS mark, regexp_matches(t, '[0-9]') AND gap > 1 AS open FROM {SIDE}),
l AS (SELECT doc_id, page, line_ix, string_agg(norm, '|' ORDER BY x0, y0, token_ix) AS print, bool_or(mark) AS marks FROM s GROUP BY doc_id, page, line_ix),
c AS (SELECT *, count(*) OVER g AS n, count(*) FILTER (marks) OVER g AS n_with FROM l WINDOW g AS (PARTITION BY doc_id, page, print)),
f AS (SELECT s.* FROM s JOIN c USING (doc_id, page, line_ix) WHERE n_with > 0 AND n_with < n AND NOT marks AND open QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_ix ORDER BY x0, y0, token_ix) = 1)
{place("near_duplicate_line", "''", 0.7, "x1", "least(y0, ny0)", "nx0", "greatest(y1, ny1)", "FROM f")}""")
def _(rows):
    return candidates.near_duplicate_lines(rows, bare=True)


@query("candidates_holes", "tokens", sql=f"""
WITH f AS (SELECT DISTINCT doc_id, page, c, r FROM (SELECT doc_id, page, c, unnest(range(CAST(trunc(y0 / 20) AS BIGINT), CAST(least(39, trunc(y1 / 20)) AS BIGINT) + 1)) AS r FROM (SELECT doc_id, page, y0, y1, unnest(range(CAST(trunc(x0 / 20) AS BIGINT), CAST(least(30, trunc(x1 / 20)) AS BIGINT) + 1)) AS c FROM {{tokens}}))),
a AS (SELECT doc_id, page, c + i AS c, r + j AS r FROM f, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j) WHERE i <> 0 OR j <> 0),
e AS (SELECT doc_id, page, c, r FROM a GROUP BY doc_id, page, c, r HAVING count(*) >= 5 AND c BETWEEN 1 AND 29 AND r BETWEEN 1 AND 38)
{place("dense_cluster_hole", "''", 0.45, "CAST(c * 20 AS DOUBLE)", "CAST(r * 20 AS DOUBLE)", "CAST(c * 20 + 20 AS DOUBLE)", "CAST(r * 20 + 20 AS DOUBLE)", "FROM e ANTI JOIN f USING (doc_id, page, c, r)")}""")
def _(tokens):
    return candidates.holes(tokens)


@query("candidates_small_circles", "curves", "marked", sql=place("vector_circle_near_number", "'°'", 0.55, "x0", "y0", "x1", "y1", "FROM {curves} c WHERE n_points >= 3 AND x1 - x0 BETWEEN 1 AND 8 AND y1 - y0 BETWEEN 1 AND 8 AND least(x1 - x0, y1 - y0) / greatest(x1 - x0, y1 - y0) >= 0.6 AND EXISTS (SELECT 1 FROM {marked} t WHERE t.doc_id = c.doc_id AND t.page = c.page AND regexp_matches(t.text, '[0-9]') AND abs(c.x0 + c.x1 - t.x0 - t.x1) < 48 AND abs(c.y0 + c.y1 - t.y0 - t.y1) < 48)"))
def _(curves, rows):
    return candidates.small_circles(curves, rows)


@query("candidates_gaps_at_lines", "drawn", "marked", sql=place("dimension_geometry_proximity", "''", 0.5, "gx0", "gy0", "gx1", "gy1", f"FROM (SELECT s.doc_id, s.page, s.x1 AS gx0, s.nx0 AS gx1, least(s.y0, s.ny0) AS gy0, greatest(s.y1, s.ny1) AS gy1 FROM {SIDE} s WHERE gap > 2) JOIN (SELECT doc_id, page, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM {{drawn}}) USING (doc_id, page) WHERE lx0 < gx1 + 10 AND lx1 > gx0 - 10 AND ly0 < gy1 + 10 AND ly1 > gy0 - 10"))
def _(drawn, rows):
    return candidates.gaps_at_lines(drawn, rows)


@query("candidates_statistics", "marked", sql=f"SELECT method, count(*) AS n, count(*) FILTER (symbol <> '') AS n_with_symbol, round(avg(confidence), 6) AS mean_confidence FROM ({' UNION ALL '.join(ALONG_SQL.values())}) GROUP BY method")
def _(rows):
    return candidates.statistics(candidates.along_lines(rows)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("candidates_surest", "marked")
def _(rows):
    found = candidates.along_lines(rows).unionByName(candidates.unread_tokens(rows)).unionByName(candidates.repeated_phrases(rows)).unionByName(candidates.narrow_tokens(rows)).unionByName(candidates.holes(rows))
    return candidates.merge(found, most=200)


@query("blocks_lines", "sheet_tokens")
def _(tokens):
    return blocks.line_table(lines.split_by_spans(lines.spans(lines.lined(tokens))))


@query("blocks_of_tokens", "sheet_tokens")
def _(tokens):
    return blocks.blocks_of(tokens)


@query("blocks_notes_columns", "sheet_tokens")
def _(tokens):
    return blocks.notes_columns(blocks.blocks_of(tokens))


@query("blocks_notes", "table_rows", sql="SELECT row_ix, regexp_matches(trim(text), '^(?:[0-9]+\\.|[A-Z]\\.|[a-z]\\.|\\([0-9]+\\)|\\([A-Za-z]\\))') OR list_bool_or(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_matches(w, '^(?:[0-9]+\\.|[A-Z]\\.|[a-z]\\.|\\([0-9]+\\)|\\([A-Za-z]\\))'))) AS notes FROM (SELECT row_ix, concat(CASE row_ix % 4 WHEN 0 THEN '1. ' WHEN 1 THEN 'SEE (b) ' WHEN 2 THEN 'A.' ELSE '' END, text) AS text FROM {table_rows})")
def _(rows):
    lead = F.when(F.col("row_ix") % 4 == 0, "1. ").when(F.col("row_ix") % 4 == 1, "SEE (b) ").when(F.col("row_ix") % 4 == 2, "A.").otherwise("")
    return rows.select("row_ix", blocks.is_note(F.trim(F.concat(lead, "text"))).alias("notes"))


@query("regions_abbreviation_rows", "table_rows", sql="SELECT row_ix, code, meaning FROM (SELECT row_ix, CASE WHEN contains(t, '=') THEN trim(split_part(t, '=', 1)) ELSE regexp_extract(t, '^([A-Z0-9]{1,5})\\s+(.+)$', 1) END AS code, CASE WHEN contains(t, '=') THEN trim(substr(t, strpos(t, '=') + 1)) ELSE regexp_extract(t, '^([A-Z0-9]{1,5})\\s+(.+)$', 2) END AS meaning FROM (SELECT row_ix, trim(text) AS t FROM {table_rows})) WHERE code <> '' AND meaning <> ''")
def _(rows):
    code, meaning = regions.abbreviation(F.col("text"))
    return rows.select("row_ix", code.alias("code"), meaning.alias("meaning")).where("code IS NOT NULL")


@query("regions_revision_rows", "table_rows", sql="SELECT row_ix, m[1] AS number, array_to_string(CASE WHEN dated THEN m[2:len(m) - 1] ELSE m[2:] END, ' ') AS description, CASE WHEN dated THEN m[len(m)] ELSE '' END AS date FROM (SELECT *, len(m) > 1 AND regexp_matches(m[len(m)], '[0-9][/.-][0-9]') AS dated FROM (SELECT row_ix, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS m FROM {table_rows}))")
def _(rows):
    number, description, date = regions.revision_row(F.split("line", r"\|"))
    return rows.select("row_ix", number.alias("number"), description.alias("description"), date.alias("date"))


@query("regions_detail_rows", "table_rows", sql="SELECT row_ix, sheet, trim(regexp_replace(trim(substr(t, length(sheet) + 1)), '^-', '')) AS description FROM (SELECT row_ix, trim(text) AS t, regexp_extract(trim(text), '^([A-Z0-9]+-?[0-9]*-?[0-9]*)', 1) AS sheet FROM {table_rows}) WHERE sheet <> ''")
def _(rows):
    sheet, description = regions.detail_row(F.col("text"))
    return rows.select("row_ix", sheet.alias("sheet"), description.alias("description")).where("sheet IS NOT NULL")


@query("regions_title_fields", "table_rows")
def _(rows):
    return regions.title_fields(rows)


@query("regions_match_rows", "tokens", sql="SELECT doc_id, page, a.token_ix AS row_ix, b.token_ix AS match_ix FROM {tokens} a JOIN {tokens} b USING (doc_id, page) WHERE a.origin = 'ocr' AND b.origin = 'text' AND abs(a.y0 - b.y0) < 5 QUALIFY row_number() OVER (PARTITION BY doc_id, page, a.token_ix ORDER BY abs(a.y0 - b.y0), b.token_ix) = 1")
def _(tokens):
    left, right = (d.select("doc_id", "page", F.col("token_ix").alias("row_ix"), F.col("y0").alias("y")) for d in _pairs(tokens))
    return regions.match_rows(left, right)


BORDER = "SELECT doc_id, page, greatest(0, min(x0) - 5) AS x0, greatest(0, min(y0) - 5) AS y0, least(612, max(x1) + 5) AS x1, least(792, max(y1) + 5) AS y1 FROM {tokens} GROUP BY doc_id, page"


@query("regions_border", "tokens", sql=BORDER)
def _(tokens):
    return regions.border(tokens)


@query("regions_drawing_zone", "tokens", "title_boxes", "notes_boxes", "entries", sql=f"SELECT doc_id, page, coalesce(c.x0, 36) AS x0, coalesce(c.y0, 36) AS y0, coalesce(n.x0, 612) AS x1, coalesce(t.y0, 792 * 0.85::DOUBLE) AS y1, 0.6::DOUBLE AS confidence FROM (SELECT doc_id, page FROM {{title_boxes}} UNION SELECT doc_id, page FROM {{notes_boxes}} UNION SELECT doc_id, page FROM {{entries}}) o LEFT JOIN ({BORDER}) c USING (doc_id, page) LEFT JOIN {{notes_boxes}} n USING (doc_id, page) LEFT JOIN {{title_boxes}} t USING (doc_id, page)")
def _(tokens, title, notes, entries):
    return regions.drawing_zone(regions.border(tokens), title, notes, entries)


@query("regions_box_kinds", "sheet_boxes", "worded", sql="""
WITH w AS (SELECT b.doc_id, b.page, b.box_ix, b.x0, b.y0, b.x1, b.y1, coalesce(string_agg(k.text, ' ' ORDER BY (k.y0 + k.y1) / 2, k.block_ix), '') AS said FROM {sheet_boxes} b LEFT JOIN {worded} k ON k.doc_id = b.doc_id AND k.page = b.page AND (k.x0 + k.x1) / 2 BETWEEN b.x0 - 4 AND b.x1 + 4 AND (k.y0 + k.y1) / 2 BETWEEN b.y0 - 4 AND b.y1 + 4 GROUP BY ALL),
k AS (SELECT doc_id, page, box_ix, CASE WHEN (x1 - x0) * (y1 - y0) / (612 * 792) >= 0.8 THEN 'page_border' WHEN (y1 - y0) / 792 >= 0.4 AND (x1 - x0) / (y1 - y0) <= 0.6 AND x1 / 612 >= 0.9 THEN 'title_block' WHEN regexp_matches(lower(said), 'sheet name|sheet no|sheet number|project name|project no') AND x1 / 612 >= 0.6 THEN 'sheet_info' WHEN regexp_matches(lower(said), 'legend|abbreviations') THEN 'legend' WHEN contains(lower(said), 'notes') THEN 'notes_box' WHEN regexp_matches(lower(said), 'location map|vicinity map|state of') THEN 'location_map' WHEN regexp_matches(lower(said), 'table|qty|quantity|schedule') THEN 'data_table' WHEN (x1 - x0) * (y1 - y0) / (612 * 792) < 0.01 AND upper(said) = said AND lower(said) <> said AND len(string_split(said, ' ')) < 6 THEN 'callout' ELSE 'unknown' END AS box_type FROM w)
SELECT *, CAST(CASE box_type WHEN 'page_border' THEN 0.95 WHEN 'title_block' THEN 0.85 WHEN 'sheet_info' THEN 0.75 WHEN 'legend' THEN 0.8 WHEN 'notes_box' THEN 0.8 WHEN 'location_map' THEN 0.7 WHEN 'data_table' THEN 0.65 WHEN 'callout' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence FROM k""")
def _(boxes, words):
    return regions.classify_boxes(boxes, words)
