"""What regions of a sheet hold: entries of tables, fields of title blocks, kinds of boxes and the zones of a page."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, box
from . import spatial

KEYS = ("doc_id", "page")
#: The fields of a title block in the order in which their labels are tried.
FIELDS = (
    ("project_name", r"PROJECT\s*(?:NAME|TITLE)\s*[:.]?"),
    ("sheet_number", r"SHEET\s*(?:NO\.?|NUMBER|#)\s*[:.]?"),
    ("sheet_title", r"SHEET\s*(?:TITLE|NAME)\s*[:.]?"),
    ("drawing_number", r"(?:DWG|DRAWING)\s*(?:NO\.?|NUMBER|#)\s*[:.]?"),
    ("date", r"(?<!REVISION\s)DATE\s*[:.]?"),
    ("revision_date", r"REVISION\s*DATE\s*[:.]?"),
    ("engineer", r"(?:ENGINEER|DESIGNED\s+BY|DESIGN(?:ER)?)\s*[:.]?"),
    ("checker", r"(?:CHECK(?:ED)?\s+BY|CHECKER|REVIEWED\s+BY)\s*[:.]?"),
    ("designer", r"(?:DRAWN\s+BY|DRAFTER|DRAFTSMAN)\s*[:.]?"),
    ("scale", r"SCALE\s*[:.]?"),
    ("job_number", r"(?:JOB|PROJECT)\s*(?:NO\.?|NUMBER|#)\s*[:.]?"),
    ("client", r"(?:CLIENT|OWNER)\s*[:.]?"),
    ("county", r"COUNTY\s*[:.]?"),
    ("state", r"STATE\s*[:.]?"),
)
SCALE = r'(?:1\s*["”]?\s*=\s*\d+|NTS|NOT\s+TO\s+SCALE)'
DATE = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*\s+\d{1,2},?\s*\d{4}"
#: Words that tell what a box is, in the order in which they are tried.
SHEET_WORDS = ("sheet name", "sheet no", "sheet number", "project name", "project no")
BOX_WORDS = (
    ("legend", 0.8, ("legend", "abbreviations")),
    ("notes_box", 0.8, ("notes",)),
    ("location_map", 0.7, ("location map", "vicinity map", "state of")),
    ("data_table", 0.65, ("table", "qty", "quantity", "schedule")),
)


def abbreviation(t: Column) -> tuple[Column, Column]:
    """Code and meaning of a row: around the first =, else a code of one to five capitals or digits before a space; null if one lacks."""
    t = F.trim(t)
    split = F.contains(t, F.lit("="))
    code = F.when(split, F.trim(F.substring_index(t, "=", 1))).otherwise(F.regexp_extract(t, r"^([A-Z0-9]{1,5})\s+(.+)$", 1))
    meaning = F.when(split, F.trim(F.regexp_replace(t, r"(?s)^[^=]*=", ""))).otherwise(F.regexp_extract(t, r"^([A-Z0-9]{1,5})\s+(.+)$", 2))
    whole = (code != "") & (meaning != "")
    return F.when(whole, code), F.when(whole, meaning)


def revision_row(texts: Column) -> tuple[Column, Column, Column]:
    """Number, description and date of a row's texts from left to right: the first, the last if it looks like a date, and those between."""
    said = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    dated = (F.size(said) > 1) & F.try_element_at(said, F.lit(-1)).rlike(r"\d[/\-.]\d")
    rest = F.slice(said, 2, F.greatest(F.lit(0), F.size(said) - F.when(dated, 2).otherwise(1)))
    return F.get(said, 0), F.when(F.size(said) > 0, F.array_join(rest, " ")), F.when(F.size(said) > 0, F.when(dated, F.try_element_at(said, F.lit(-1))).otherwise(""))


def detail_row(t: Column) -> tuple[Column, Column]:
    """Sheet and description of a row such as "AB-5-1 - END PIECE"; null if it doesn't begin with a sheet."""
    t = F.trim(t)
    sheet = F.regexp_extract(t, r"^([A-Z0-9]+-?\d*-?\d*)", 1)
    rest = F.trim(F.regexp_replace(F.trim(F.substr(t, F.length(sheet) + 1)), "^-", ""))
    return F.when(sheet != "", sheet), F.when(sheet != "", rest)


def _fields(keys):
    labels = [(k, re.compile(p, re.I)) for k, p in FIELDS]
    scale, date = re.compile(SCALE, re.I), re.compile(DATE, re.I)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        texts = p.sort_values(["y0", "row_ix"], kind="stable").text.fillna("").str.strip()
        texts = texts[texts != ""].tolist()
        got: dict[str, tuple[str, float]] = {}
        used: set[int] = set()
        for i, t in enumerate(texts):
            hit = next(((k, m) for k, pattern in labels if (m := pattern.search(t))), None)
            if hit is None:
                continue
            value = t[hit[1].end() :].strip().rstrip(":.")
            if not value and i + 1 < len(texts) and i + 1 not in used:
                value = texts[i + 1]
                used.add(i + 1)
            if value:
                got.setdefault(hit[0], (value, 0.85))
            used.add(i)
        for i, t in enumerate(texts):
            if i not in used and "scale" not in got and scale.search(t):
                got["scale"] = (t, 0.6)
            elif i not in used and "date" not in got and (m := date.search(t)):
                got["date"] = (m.group(), 0.55)
        sure = round(sum(k in got for k in ("project_name", "sheet_number", "date", "scale")) / 4, 2)
        return pd.DataFrame([[*(p[k].iloc[0] for k in keys), label, value, c, sure] for label, (value, c) in got.items()], columns=[*keys, "label", "value", "confidence", "block_confidence"])

    return run


def title_fields(rows: DataFrame, keys=KEYS) -> DataFrame:
    """The fields of each title block from its rows of text (the keys, row_ix, y0, text): the value after a label, else the next row.

    Then scales and dates without a label, in rows not used. The first value of a field counts. Which rows are used depends on those above,
    so a title block, which a box bounds, is a group.
    """
    kinds = dict(rows.dtypes)
    slim = rows.select(*keys, "row_ix", "y0", "text")
    return slim.groupBy(*keys).applyInPandas(_fields(keys), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "label string, value string, confidence double, block_confidence double"]))


def classify_boxes(boxes: DataFrame, blocks: DataFrame, size=(612.0, 792.0), border: float = 0.8, tall: float = 0.4, aspect: float = 0.6, right: float = 0.9, room: float = 4.0, small: float = 0.01, parts: int = 6, keys=KEYS) -> DataFrame:
    """box_type and confidence of boxes (the keys, box_ix, box) by extent and by the words of the blocks (the keys, block_ix, box, text) whose
    centres they hold, but for `room` on each side. The first rule that fits counts; texts stand from the top."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = blocks.select(*keys, "block_ix", "text", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    grown = boxes.select(*keys, "box_ix", *[(F.col(k) + (-room if k.endswith("0") else room)).alias(k) for k in ("x0", "y0", "x1", "y1")])
    inside = spatial.candidates(grown, points, lambda a, b: (b.x0 >= a.x0) & (b.x0 <= a.x1) & (b.y0 >= a.y0) & (b.y0 <= a.y1), keys)
    words = inside.groupBy(*keys, "box_ix").agg(F.array_sort(F.collect_list(F.struct("y0_r", "block_ix_r", "text_r"))).alias("m")).select(*keys, "box_ix", F.array_join(F.transform("m", lambda r: r["text_r"]), " ").alias("words"))
    b, said = box(), F.coalesce("words", F.lit(""))
    share, wide = area(b) / (size[0] * size[1]), F.when(b.y1 > b.y0, (b.x1 - b.x0) / (b.y1 - b.y0))
    holds = lambda ws: reduce(lambda c, w: c | F.contains(F.lower(said), F.lit(w)), ws, F.lit(False))
    rules = [("page_border", 0.95, share >= border), ("title_block", 0.85, ((b.y1 - b.y0) / size[1] >= tall) & (wide <= aspect) & (b.x1 / size[0] >= right)), ("sheet_info", 0.75, holds(SHEET_WORDS) & (b.x1 / size[0] >= 0.6))]
    rules += [(k, c, holds(ws)) for k, c, ws in BOX_WORDS]
    rules.append(("callout", 0.5, (share < small) & said.rlike("[A-Z]") & ~said.rlike("[a-z]") & (F.size(F.split(F.trim(said), r"\s+")) < parts)))
    kind = reduce(lambda c, r: c.when(r[2], F.struct(F.lit(r[0]).alias("box_type"), F.lit(r[1]).alias("confidence"))), rules, F.when(F.lit(False), F.struct(F.lit("").alias("box_type"), F.lit(0.0).alias("confidence"))))
    return boxes.join(words, [*keys, "box_ix"], "left").withColumn("kind", kind.otherwise(F.struct(F.lit("unknown").alias("box_type"), F.lit(0.3).alias("confidence")))).select(*keys, "box_ix", "kind.*")


def border(blocks: DataFrame, size=(612.0, 792.0), room: float = 5.0, keys=KEYS) -> DataFrame:
    """The keys and the box of each page's content, `room` wider but within the sheet."""
    edge = lambda f, k, limit: (F.greatest(F.lit(0.0), f(k) - room) if limit is None else F.least(F.lit(limit), f(k) + room)).alias(k)
    return blocks.groupBy(*keys).agg(edge(F.min, "x0", None), edge(F.min, "y0", None), edge(F.max, "x1", size[0]), edge(F.max, "y1", size[1]))


def drawing_zone(content: DataFrame, title: DataFrame, notes: DataFrame, regions: DataFrame, size=(612.0, 792.0), keys=KEYS) -> DataFrame:
    """The drawing's zone on pages with another zone: from the content's top left to the notes' left and the title block's top.

    title and notes hold at most a box a page. Without a title block it ends at 0.85 of the sheet's height, without notes at its right edge.
    """
    other = title.select(*keys).unionByName(notes.select(*keys)).unionByName(regions.select(*keys)).distinct()
    low, side = title.select(*keys, F.col("y0").alias("title_y")), notes.select(*keys, F.col("x0").alias("notes_x"))
    held = other.join(content, list(keys), "left").join(low, list(keys), "left").join(side, list(keys), "left")
    # a page without blocks has a margin of half an inch
    return held.select(*keys, F.coalesce("x0", F.lit(36.0)).alias("x0"), F.coalesce("y0", F.lit(36.0)).alias("y0"), F.coalesce("notes_x", F.lit(size[0])).alias("x1"), F.coalesce("title_y", F.lit(size[1] * 0.85)).alias("y1"), F.lit(0.6).alias("confidence"))


def match_rows(left: DataFrame, right: DataFrame, tolerance: float = 5.0, keys=KEYS) -> DataFrame:
    """The keys, row_ix and match_ix: for each row of left the nearest of right by y within the tolerance (ties to the smaller row_ix); a row
    of right may serve several."""
    band = lambda v: F.floor(v / tolerance)
    wide = left.select(*keys, "row_ix", "y", F.explode(F.array(*[band(F.col("y")) + i for i in (-1, 0, 1)])).alias("band"))
    met = wide.join(right.select(*keys, F.col("row_ix").alias("match_ix"), F.col("y").alias("ry"), band(F.col("y")).alias("band")), [*keys, "band"]).withColumn("far", F.abs(F.col("y") - F.col("ry"))).where(F.col("far") < tolerance)
    first = Window.partitionBy(*keys, "row_ix").orderBy("far", "match_ix")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*keys, "row_ix", "match_ix")
