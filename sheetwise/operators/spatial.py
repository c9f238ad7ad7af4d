"""Joins of boxes: grid cells make them equi-joins, so no page is ever compared with itself in full."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, center, intersection, iou, overlaps
from .paged import by_page, numbers, ranges, spread

CELL = 50.0
#: What a page is known by.
KEYS = ("doc_id", "page")


def cells(df: DataFrame, size: float = CELL, margin: float = 0.0) -> DataFrame:
    """A row for each grid cell that a box touches: cx and cy."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - margin) / size).cast("int"), F.floor((F.col(b) + margin) / size).cast("int")))
    return df.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def _suffixed(df: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else c + suffix) for c in df.columns])


def candidates(left: DataFrame, right: DataFrame, condition, keys=KEYS, margin: float = 0.0) -> DataFrame:
    """Pairs of one page whose boxes share a cell and meet the condition, each once. Columns of right end in _r.

    A pair is made only in the first cell that the two have in common, so no distinct is needed. The sides are shuffled whatever size they
    seem to have: Spark reckons a side without the cells that its boxes are unfolded into, and would broadcast far more than it thinks.
    """
    a = cells(left, margin=margin)
    b = cells(_suffixed(right, "_r", list(keys)).withColumnsRenamed({f"{k}_r": k for k in ("x0", "y0", "x1", "y1")}), margin=0.0).withColumnsRenamed({k: f"{k}_r" for k in ("x0", "y0", "x1", "y1")})
    joined = a.join(b.hint("merge"), [*keys, "cx", "cy"])
    first_x = F.greatest(F.floor((F.col("x0") - margin) / CELL), F.floor(F.col("x0_r") / CELL))
    first_y = F.greatest(F.floor((F.col("y0") - margin) / CELL), F.floor(F.col("y0_r") / CELL))
    return joined.where((F.col("cx") == first_x) & (F.col("cy") == first_y)).where(condition(box(), box(suffix="_r"))).drop("cx", "cy")


def best_match(ocr: DataFrame, pdf: DataFrame, threshold: float = 0.3, tolerance: float = 12.0, keys=KEYS) -> DataFrame:
    """For each box of ocr its match in pdf: the best overlap from the threshold on, else the nearest centre within the tolerance.

    Columns: the keys, token_ix, match_ix and match_type (iou, center, unmatched); ties to the smaller token_ix. Only boxes that share a grid
    cell are compared.
    """
    (ax, ay), (bx, by) = center(box()), center(box(suffix="_r"))
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    # only pairs that may count leave the join
    near = candidates(ocr, pdf, lambda a, b: (iou(a, b, clamp=True) >= threshold) | ((dx <= tolerance) & (dy <= tolerance)), keys)
    scored = near.select(*keys, "token_ix", "token_ix_r", iou(box(), box(suffix="_r"), clamp=True).alias("iou"), F.when((dx <= tolerance) & (dy <= tolerance), dx + dy).alias("far"))
    best = scored.groupBy(*keys, "token_ix").agg(
        F.min(F.when(F.col("iou") >= threshold, F.struct((-F.col("iou")).alias("s"), F.col("token_ix_r").alias("ix")))).alias("by_iou"),
        F.min(F.when(F.col("far").isNotNull(), F.struct(F.col("far").alias("s"), F.col("token_ix_r").alias("ix")))).alias("by_center"),
    )
    kind = F.when(F.col("by_iou").isNotNull(), "iou").when(F.col("by_center").isNotNull(), "center").otherwise("unmatched")
    return ocr.select(*keys, "token_ix").join(best, [*keys, "token_ix"], "left").select(*keys, "token_ix", F.coalesce("by_iou.ix", "by_center.ix").alias("match_ix"), kind.alias("match_type"))


def covered(left: DataFrame, right: DataFrame, condition=overlaps, anti: bool = False, keys=KEYS) -> DataFrame:
    """Rows of left that some box of right meets (or none, if anti), by the keys and token_ix."""
    hits = candidates(left, right, condition, keys).select(*keys, "token_ix").distinct()
    return left.join(hits, [*keys, "token_ix"], "left_anti" if anti else "left_semi")


def best_zone(boxes: DataFrame, zones: DataFrame, least: float = 0.3, keys=KEYS) -> DataFrame:
    """The keys, token_ix and the zone that covers most of the box, if over `least`; ties to the smaller zone_ix."""
    share = F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), intersection(box(), box(suffix="_r")) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).otherwise(0.0)
    met = candidates(boxes, zones, lambda a, b: overlaps(a, b), keys).withColumn("share", share).where(F.col("share") > least)
    return met.groupBy(*keys, "token_ix").agg(F.min(F.struct((-F.col("share")).alias("s"), F.col("zone_ix_r").alias("zone_ix"))).alias("m")).select(*keys, "token_ix", "m.zone_ix")


def nearest_digits(boxes: DataFrame, tokens: DataFrame, gap: float = 40.0, keys=KEYS) -> DataFrame:
    """The keys, token_ix, left_ix and right_ix: the nearest digit tokens on either side, overlapping in height, within the gap."""
    digits = tokens.where(F.col("text").rlike(r"^\d"))
    a, b = box(), box(suffix="_r")
    band = (F.least(a.y1, b.y1) > F.greatest(a.y0, b.y0)) & (F.col("token_ix") != F.col("token_ix_r"))
    # the box is widened by the gap for its cells, so that both sides' digits share one with it
    met = candidates(boxes, digits, lambda *_: band, keys, margin=gap)
    left, right = a.x0 - b.x1, b.x0 - a.x1
    pick = lambda d: F.min(F.when((d >= 0) & (d <= gap), F.struct(d.alias("d"), F.col("token_ix_r").alias("ix"))))
    best = met.groupBy(*keys, "token_ix").agg(pick(left).alias("l"), pick(right).alias("r"))
    return boxes.select(*keys, "token_ix").join(best, [*keys, "token_ix"], "left").select(*keys, "token_ix", F.col("l.ix").alias("left_ix"), F.col("r.ix").alias("right_ix"))


def greedy_nms(threshold: float):
    """For applyInPandas by page: the largest box first (ties to the smaller token_ix), those that overlap a kept one by the threshold go."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        p = page.assign(_area=np.maximum(page.x1 - page.x0, 0) * np.maximum(page.y1 - page.y0, 0)).sort_values(["_area", "token_ix"], ascending=[False, True], kind="stable")
        x0, y0, x1, y1 = (p[k].to_numpy() for k in ("x0", "y0", "x1", "y1"))
        size = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
        alive = np.ones(len(p), bool)
        for i in range(len(p)):
            if alive[i]:
                both = np.maximum(np.minimum(x1, x1[i]) - np.maximum(x0, x0[i]), 0) * np.maximum(np.minimum(y1, y1[i]) - np.maximum(y0, y0[i]), 0)
                union = size + size[i] - both
                hit = (both > 0) & (union > 0) & (both >= threshold * union)
                hit[: i + 1] = False
                alive &= ~hit
        return p[alive].drop(columns="_area")

    return run


def nms(tokens: DataFrame, threshold: float = 0.5, keys=KEYS) -> DataFrame:
    """Greedy suppression is sequential within a page, so a page is a group; pages are independent and bounded by a sheet's tokens.

    Only the boxes that overlap another one are grouped; the others stay where they are.
    """
    a, b = box(), box(suffix="_r")
    met = candidates(tokens, tokens, lambda *_: overlaps(a, b) & (F.col("token_ix") != F.col("token_ix_r")), keys).select(*keys, "token_ix").distinct()
    kept = tokens.join(met, [*keys, "token_ix"], "left_semi").groupBy(*keys).applyInPandas(greedy_nms(threshold), tokens.schema)
    return kept.unionByName(tokens.join(met, [*keys, "token_ix"], "left_anti"))


def overlap_clusters(tokens: DataFrame, keys=KEYS) -> DataFrame:
    """The keys, token_ix and cluster: the smallest token_ix that chains of overlapping boxes of the page reach.

    Pairs come from the cell join; a page's pairs, not its boxes, are walked.
    """
    a, b = box(), box(suffix="_r")
    pairs = candidates(tokens, tokens, lambda *_: overlaps(a, b) & (F.col("token_ix") < F.col("token_ix_r")), keys).select(*keys, "token_ix", F.col("token_ix_r").alias("other"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := own.setdefault(x, x)) != x:
                own[x] = own[up]
                x = up
            return x

        for x, y in zip(p.token_ix.tolist(), p.other.tolist(), strict=True):
            low, high = sorted((root(x), root(y)))
            own[high] = low
        out = pd.DataFrame({"token_ix": list(own), "cluster": [root(x) for x in own]})
        return out.assign(**{k: p[k].iloc[0] for k in keys})[[*keys, "token_ix", "cluster"]]

    kinds = dict(tokens.dtypes)
    found = pairs.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "token_ix bigint", "cluster bigint"]))
    return tokens.select(*keys, "token_ix").join(found, [*keys, "token_ix"], "left").select(*keys, "token_ix", F.coalesce("cluster", "token_ix").alias("cluster"))


def enclosing_rect(headers: DataFrame, rects: DataFrame, tolerance: float = 20.0, keys=KEYS) -> DataFrame:
    """The keys, token_ix and zone_ix of the first rectangle over 100 x 50 that holds the box, but for the tolerance on each side."""
    a, b = box(), box(suffix="_r")
    holds = (b.x0 <= a.x0 + tolerance) & (b.y0 <= a.y0 + tolerance) & (b.x1 >= a.x1 - tolerance) & (b.y1 >= a.y1 - tolerance)
    met = candidates(headers, rects.where("x1 - x0 > 100 and y1 - y0 > 50"), lambda *_: holds, keys, margin=tolerance)
    return met.groupBy(*keys, "token_ix").agg(F.min("zone_ix_r").alias("zone_ix"))


def symbols_in(shapes: DataFrame, regions: DataFrame, most: float = 50.0, keys=KEYS) -> DataFrame:
    """The keys, zone_ix and token_ix of shapes within a region (its edges included), no wider or higher than `most`."""
    a, b = box(), box(suffix="_r")
    inside = (a.x0 >= b.x0) & (a.x1 <= b.x1) & (a.y0 >= b.y0) & (a.y1 <= b.y1)
    small = shapes.where((F.col("x1") - F.col("x0") <= most) & (F.col("y1") - F.col("y0") <= most))
    return candidates(small, regions, lambda *_: inside, keys).select(*keys, F.col("zone_ix_r").alias("zone_ix"), "token_ix")


def boxes_in(boxes: DataFrame, regions: DataFrame, keys=KEYS) -> DataFrame:
    """The keys, zone_ix and token_ix of boxes that meet a region, touching included."""
    return candidates(boxes, regions, lambda a, b: overlaps(a, b, touching=True), keys).select(*keys, F.col("zone_ix_r").alias("zone_ix"), "token_ix")


def center_in(boxes: DataFrame, regions: DataFrame, pad: float = 4.0, keys=KEYS) -> DataFrame:
    """The keys, zone_ix and token_ix of boxes whose centre lies in a region widened by pad."""
    (x, y), b = center(box()), box(suffix="_r")
    inside = (x >= b.x0 - pad) & (x <= b.x1 + pad) & (y >= b.y0 - pad) & (y <= b.y1 + pad)
    return candidates(boxes, regions, lambda *_: inside, keys, margin=pad).select(*keys, F.col("zone_ix_r").alias("zone_ix"), "token_ix")


def line_neighbours(boxes: DataFrame, tokens: DataFrame, reach: float, factor: float = 0.6, least: float = 3.0, keys=KEYS) -> DataFrame:
    """The keys, token_ix, neighbour_ix and place, from the left: text tokens whose centre is within a box's band (factor times its height, at
    least `least`) and that meet it widened by reach on both sides."""
    a, b = box(), box(suffix="_r")
    (_, ay), (_, by) = center(a), center(b)
    band = F.greatest(F.lit(least), (a.y1 - a.y0) * factor)
    near = (F.abs(by - ay) <= band) & (b.x1 >= a.x0 - reach) & (b.x0 <= a.x1 + reach)
    met = candidates(boxes, tokens.where("origin = 'text'"), lambda *_: near, keys, margin=reach)
    place = F.row_number().over(Window.partitionBy(*keys, "token_ix").orderBy("x0_r", "token_ix_r"))
    return met.select(*keys, "token_ix", F.col("token_ix_r").alias("neighbour_ix"), place.alias("place"))


def _paired(keys, tolerance: float, reach: float):
    def run(table: pa.Table, page: np.ndarray) -> pa.Table:
        x, y = numbers(table, "x", "y")
        symbol = table.column("symbol").to_numpy()
        ids = table.column("ix").fill_null(0).to_numpy()
        s = np.flatnonzero(symbol)
        lost = table.column("ix").is_null().to_numpy()
        s = s[np.lexsort((lost[s], ids[s], page[s]))]
        # repeats of a symbol or row are one
        code = np.cumsum(np.r_[False, (page[s][1:] != page[s][:-1]) | (ids[s][1:] != ids[s][:-1]) | (lost[s][1:] != lost[s][:-1])]) if len(s) else s
        r = np.flatnonzero(~symbol & ~np.isnan(x) & ~np.isnan(y))
        asks = np.flatnonzero(~np.isnan(x[s]) & ~np.isnan(y[s]))
        a = s[asks]
        slack = tolerance + 1e-9 * (1 + np.abs(y[a]))
        order, start, stop = ranges(page[r], y[r], page[a], y[a] - slack, y[a] + slack)
        r = r[order]
        taken, found, paired = set(), np.zeros(len(s), np.int64), np.zeros(len(s), bool)
        bounds = np.r_[0, np.cumsum(stop - start)]
        at = 0
        while at < len(a):
            # so many askers that their pairs stay few, none of them cut; all repeats of a symbol stand together
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 4_000_000, "right")) - 1)
            while end < len(a) and code[asks[end]] == code[asks[end - 1]]:
                end += 1
            k, place = spread(start[at:end], stop[at:end])
            k += at
            own, row = a[k], r[place]
            gap, high = x[row] - x[own], np.abs(y[row] - y[own])
            fits = (gap >= 0) & (gap <= reach) & (high <= tolerance)
            own, row, which = own[fits], row[fits], code[asks[k[fits]]]
            best = np.lexsort((ids[row], gap[fits] + high[fits], which))
            last = -1
            for c, p, ix in zip(which[best].tolist(), page[own[best]].tolist(), ids[row[best]].tolist(), strict=True):
                if c != last and (p, ix) not in taken:
                    taken.add((p, ix))
                    found[c], paired[c], last = ix, True, c
            at = end
        return pa.table([*(table.column(k).take(pa.array(s)) for k in keys), table.column("ix").take(pa.array(s)), pa.array(found[code], mask=~paired[code])], names=[*keys, "symbol_ix", "row_ix"])

    return run


def pair_symbols(symbols: DataFrame, rows: DataFrame, tolerance: float = 20.0, reach: float = 300.0, keys=KEYS) -> DataFrame:
    """The keys, symbol_ix and row_ix: symbols in order take the nearest free row of text to their right, by gap plus difference in height;
    null if there is none. Which rows are free depends on the symbols before, so a page is a group; its boxes, not their cells, are shuffled,
    and a symbol meets only the rows within the tolerance of its height. Without a page or a number nothing is paired."""
    known = lambda ix: reduce(lambda c, k: c & F.col(k).isNotNull(), keys, F.col(ix).isNotNull())
    side = lambda df, ix, x, symbol: df.select(*keys, F.col(ix).cast("long").alias("ix"), F.when(known(ix), F.col(x).cast("double")).alias("x"), center(box())[1].cast("double").alias("y"), F.lit(symbol).alias("symbol"))
    kinds = dict(symbols.dtypes)
    both = side(symbols, "symbol_ix", "x1", True).unionByName(side(rows, "row_ix", "x0", False))
    return by_page(both, _paired(keys, tolerance, reach), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "symbol_ix bigint", "row_ix bigint"]), keys)
