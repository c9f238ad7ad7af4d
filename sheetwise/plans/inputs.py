"""Inputs of the registered queries: positioned tokens, notes, detections and corrections derived from the driver's tables.

Each is SQL that Spark and other engines read alike; {name} stands for a table. Numbers are whole or exact in binary.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INPUTS = {
    "tokens": """
SELECT CAST(floor(k / 32.0) AS BIGINT) % 5 AS doc_id, CAST(floor(k / 160.0) AS BIGINT) AS page, k * 8 + n AS token_ix, CAST(p * 37 % 560 AS DOUBLE) AS x0, CAST(s * 13 % 40 * 18 + n AS DOUBLE) AS y0,
  CAST(p * 37 % 560 AS DOUBLE) + q + 10 AS x1, CAST(s * 13 % 40 * 18 + n AS DOUBLE) + 10 AS y1,
  CASE WHEN p % 3 = 0 THEN CAST(s % 100 AS VARCHAR(9)) WHEN p % 3 = 1 THEN concat(f, 'B', f) ELSE concat('NOTE ', CAST(p % 12 AS VARCHAR(9)), CASE WHEN p % 2 = 0 THEN '%' ELSE '' END) END AS text,
  CASE WHEN n % 2 = 0 THEN 'text' ELSE 'ocr' END AS origin, CAST(8 + p % 5 AS DOUBLE) AS font_size, CAST(p % 8 AS DOUBLE) / 8 AS confidence, CASE WHEN p % 2 = 0 THEN 'Arial' ELSE 'Mono' END AS fontname
FROM (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) AS f FROM {lineitem} GROUP BY l_orderkey, l_linenumber) t""",
    "lined": "SELECT *, CAST(floor((y0 + y1) / 2 / 18) AS INT) AS line_ix FROM {tokens}",
    "marked": """
SELECT doc_id, page, token_ix, x0, y0, x1, y1, line_ix, font_size, fontname, CASE CAST(x0 AS BIGINT) % 19 WHEN 1 THEN 'TYP' WHEN 2 THEN 'Dia' WHEN 3 THEN 'OC' WHEN 4 THEN 'REBAR' WHEN 5 THEN '3/4' WHEN 6 THEN '2.5' WHEN 7 THEN 'TOL' WHEN 8 THEN '(cid:7)' WHEN 9 THEN '7@' WHEN 10 THEN 'MM' WHEN 11 THEN ' ' WHEN 12 THEN '4' WHEN 13 THEN '4' WHEN 14 THEN '#5' ELSE text END AS text FROM {lined}""",
    "chars": "SELECT doc_id, page, x0, y0, x0 + CAST(token_ix % 3 AS DOUBLE) / 4 AS x1, y1, fontname, CASE WHEN token_ix % 11 = 0 THEN '' WHEN token_ix % 13 = 0 THEN '(cid:3)' ELSE 'a' END AS text FROM {tokens}",
    "drawn": "SELECT doc_id, page, x0, y0 + 4 AS y0, x0 + font_size * 5 AS x1, y0 + 4 AS y1 FROM {tokens} WHERE origin = 'ocr'",
    "curves": "SELECT doc_id, page, token_ix AS curve_ix, x0 - 9 AS x0, y0 AS y0, x0 - 9 + font_size - 6 AS x1, y0 + 4 AS y1, CAST(token_ix % 7 AS BIGINT) AS n_points FROM {tokens}",
    "table_rows": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, p_partkey AS row_ix, CAST(p_partkey % 40 * 18 AS DOUBLE) AS y0, CASE p_partkey % 6 WHEN 0 THEN concat('A', CAST(p_partkey % 97 AS VARCHAR(9)), ' = ', p_name, ' = x') WHEN 1 THEN concat(' C', CAST(p_partkey % 97 AS VARCHAR(9)), '  ', p_name) WHEN 2 THEN concat('AB-', CAST(p_partkey % 9 AS VARCHAR(9)), '-1 - ', p_name) WHEN 3 THEN concat('= ', p_name) WHEN 4 THEN concat('SCALE: ', CAST(p_partkey % 9 AS VARCHAR(9))) ELSE p_name END AS text, concat(CAST(p_partkey % 7 AS VARCHAR(9)), '| |', p_name, CASE p_partkey % 3 WHEN 0 THEN '|3/4/21' WHEN 1 THEN '|late' ELSE '' END) AS line FROM {part}",
    "title_boxes": "SELECT doc_id, page, min(region_ix) * 7 + 400.0E0 AS x0, 600.0E0 + count(*) AS y0, 610.0E0 AS x1, 790.0E0 AS y1 FROM {regions} GROUP BY doc_id, page",
    "notes_boxes": "SELECT doc_id, page, 350.0E0 + count(*) AS x0, 20.0E0 AS y0, 600.0E0 AS x1, 500.0E0 AS y1 FROM {notes} GROUP BY doc_id, page",
    "sheet_boxes": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, p_partkey AS box_ix, CAST(p_partkey * 7 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 11 % 300 AS DOUBLE) AS y0, CASE WHEN p_partkey % 5 = 0 THEN 600.0E0 ELSE CAST(p_partkey * 7 % 500 + p_size AS DOUBLE) END AS x1, CAST(p_partkey * 11 % 300 + p_size * (1 + p_partkey % 8) AS DOUBLE) AS y1 FROM {part}",
    "worded": "SELECT doc_id, page, token_ix AS block_ix, x0, y0, x1, y1, CASE CAST(x0 AS BIGINT) % 29 WHEN 1 THEN 'UTILITY LEGEND' WHEN 2 THEN 'Sheet No. 4' WHEN 3 THEN 'QTY' WHEN 4 THEN 'STATE OF' WHEN 5 THEN 'Drainage Notes' WHEN 6 THEN 'lower' ELSE 'DETAIL A' END AS text FROM {tokens}",
    "sheet_tokens": "SELECT doc_id, page, token_ix, x0, y0, x1, y1, origin, font_size, confidence, fontname, CASE CAST(x0 AS BIGINT) % 7 WHEN 1 THEN '1.' WHEN 2 THEN 'SITE NOTES:' WHEN 3 THEN '(b)' ELSE text END AS text FROM {tokens}",
    "zones": "SELECT doc_id, page, CAST(0 AS BIGINT) AS zone_ix, 0.0E0 AS x0, 0.0E0 AS y0, 300.0E0 AS x1, 400.0E0 AS y1 FROM {tokens} GROUP BY doc_id, page UNION ALL SELECT doc_id, page, CAST(1 AS BIGINT), 300.0E0, 0.0E0, 620.0E0, 400.0E0 FROM {tokens} GROUP BY doc_id, page",
    "notes": "SELECT CAST(floor(o_orderkey / 16.0) AS BIGINT) % 5 AS doc_id, CAST(floor(o_orderkey / 80.0) AS BIGINT) AS page, CAST(o_custkey % 2 AS INT) AS column_ix, o_orderkey AS ord, CAST(o_orderkey % 16 + o_custkey % 3 AS INT) AS number, concat(CASE WHEN o_custkey % 3 = 0 THEN 'See note ' WHEN o_custkey % 3 = 1 THEN 'REFER  TO NOTE #' ELSE 'NOTE ' END, CAST(o_custkey % 19 AS VARCHAR(9)), CASE o_orderkey % 4 WHEN 0 THEN ' FOR AB' WHEN 1 THEN ' CDE AND CDE' WHEN 2 THEN ' ROAD' ELSE ' Xy' END) AS text FROM {orders}",
    "columns": "SELECT doc_id, page, column_ix, CASE WHEN sum(ord) % 3 = 0 THEN ' ' WHEN sum(ord) % 3 = 1 THEN 'NOTES:' END AS header, count(*) AS n_notes FROM {notes} GROUP BY doc_id, page, column_ix",
    "entries": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, CAST(p_partkey % 3 AS BIGINT) AS region_ix, concat(CASE WHEN p_partkey % 7 = 0 THEN ' a' ELSE 'A' END, CASE WHEN p_partkey % 5 = 0 THEN 'B ' ELSE CAST(p_partkey % 97 AS VARCHAR(9)) END) AS code, p_name AS meaning FROM {part}",
    "regions": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, CAST(p_partkey % 5 AS BIGINT) AS region_ix, CASE WHEN p_partkey % 5 = 0 THEN 'legend' WHEN p_partkey % 5 < 3 THEN 'abbreviation' ELSE 'revision' END AS region_type, min(CASE WHEN p_partkey % 3 = 0 THEN p_name END) AS header FROM {part} GROUP BY 1, 2, 3, 4",
    "details": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 's-2 ' ELSE concat('S-', CAST(p_partkey % 9 AS VARCHAR(9))) END AS sheet, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS description FROM {part}",
    "symbols": "SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS page, concat('box_', CAST(p_size AS VARCHAR(9))) AS symbol, CASE WHEN p_size % 2 = 0 THEN ' one ' WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS description FROM {part}",
    "revisions": "SELECT c_nationkey AS doc_id, CAST(floor(c_custkey / 60.0) AS BIGINT) AS page, CAST(c_custkey % 2 AS BIGINT) AS region_ix, c_custkey AS ord, CASE WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 17 = 0 THEN 'A' ELSE CAST(c_custkey % 11 * (c_nationkey % 3) + 1 AS VARCHAR(9)) END AS number, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS description, CAST(o.d AS DATE) AS date FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey",
    "fields": "SELECT s_suppkey % 5 AS doc_id, CAST(floor(s_suppkey / 15.0) AS BIGINT) AS page, CASE WHEN s_suppkey % 3 = 0 THEN 'sheet_number' WHEN s_suppkey % 3 = 1 THEN 'date' ELSE 'scale' END AS label, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS value FROM {supplier}",
    "pages_q": "SELECT doc_id, page, CASE WHEN page % 10 = 0 THEN NULL WHEN page % 3 = 0 THEN concat(' s-', CAST(page % 40 AS VARCHAR(9))) ELSE concat('S-', CAST(page % 40 AS VARCHAR(9))) END AS sheet, CAST(count(*) % 5 AS DOUBLE) / 4 AS quality, CAST(count(*) % 8 AS DOUBLE) / 8 AS confidence FROM {tokens} GROUP BY doc_id, page",
    "detections": "SELECT o_orderkey AS detection_id, o_custkey % 50 AS doc_id, CAST(o_orderkey % 20 AS INT) AS page, CASE WHEN o_orderkey % 17 = 0 THEN 'manual' ELSE concat('run', CAST(o_orderkey % 4 AS VARCHAR(9))) END AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'notes' WHEN o_orderkey % 3 = 1 THEN 'legend' ELSE 'header' END AS element_type, CAST(o_custkey % 64 AS DOUBLE) / 64 AS confidence, CAST(o_orderdate AS DATE) AS created_at, CAST(o_custkey % 500 AS DOUBLE) AS x0, CAST(o_custkey % 700 AS DOUBLE) AS y0, CAST(o_custkey % 500 + o_orderkey % 90 AS DOUBLE) AS x1, CAST(o_custkey % 700 + 10 AS DOUBLE) AS y1 FROM {orders}",
    "corrections": "SELECT event_id AS seq, CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id * 7 % 9000 END AS detection_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_id % 2 = 0 THEN 'accept' ELSE 'relabel' END AS correction_type, CASE WHEN user_id % 2 = 0 THEN 'legend' ELSE 'title' END AS corrected_element_type, ts AS corrected_at FROM {events}",
    "members": "SELECT CAST(floor(o_orderkey / 12.0) AS BIGINT) AS group_id, o_orderkey AS detection_id FROM {orders}",
    "groups": "SELECT group_id, CASE WHEN group_id % 4 = 0 THEN max(detection_id) ELSE min(detection_id) END AS root_detection_id FROM {members} GROUP BY group_id",
    "images": "SELECT doc_id, page, run_id, concat(run_id, '-', CAST(detection_id AS VARCHAR(20)), '.png') AS path, created_at, detection_id FROM {detections}",
    "training": "SELECT s_suppkey AS run_id, s_suppkey % 9 AS trained_at, CAST(s_suppkey % 17 AS DOUBLE) / 16 AS f1_macro, CAST(s_suppkey % 23 AS DOUBLE) / 32 AS f1_weighted FROM {supplier}",
    "entities": "SELECT event_id, CAST(user_id % 40 AS BIGINT) AS page, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN concat('V', CAST(event_id % 12 AS VARCHAR(9))) ELSE concat('v', CAST(event_id % 12 AS VARCHAR(9))) END AS value FROM {events}",
    "outcomes": "SELECT event_id, event_type AS m1, CASE WHEN event_id % 3 = 0 THEN 'gap' ELSE 'grid' END AS m2, CASE WHEN event_id % 5 = 0 THEN 'pending' WHEN event_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS outcome FROM {events}",
    "calls": "SELECT event_id, event_type AS model, CAST(user_id * 10 AS BIGINT) AS input_tokens, CAST(event_id % 500 AS BIGINT) AS output_tokens FROM {events}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def resolve(name: str, table) -> str:
    """The SQL of an input with the inputs it uses put in; table(name) is how the engine names a table."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({resolve(m[1], table)}) {m[1]}_" if m[1] in INPUTS else table(m[1]), INPUTS[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(resolve(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def with_inputs(sql: str) -> str:
    """SQL for another engine: {name} becomes the input's query, or the table of that name."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({resolve(m[1], str)})" if m[1] in INPUTS else m[1], sql)
