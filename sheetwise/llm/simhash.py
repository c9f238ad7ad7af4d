"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import connected_components, join_unique, lean, materialize, read_table, ship

SHINGLE, SEED = 3, 42
#: Most differing bits of a link, and the segments in the ring.
LIMIT, SEGMENTS = 3, 8
#: Rows that a task compares in memory under one key; larger groups are dealt anew under finer keys.
GROUP = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is 1 if set in over half the hashes of the shingles of the lower-cased words (all words if fewer; 0 without any)."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    shingles = map(join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [join(words)]
    return near_copies.majority(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text").cast(pa.large_binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; null counts as empty."""
    ship(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def ring_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint) of all candidate keys.

    Over 8 segments of 8 bits in a ring, a pair within 3 bits has a start from which each run of k segments differs by at most 3k/8 bits
    (rounded down): 0 over two segments and 1 over five. So the first two are equal, and of the next three at least two. A key is the
    start, which two, and these four segments. The check of the pair tests all runs again.
    """
    seg = prints.view(np.uint8).reshape(-1, 8).astype(np.uint64)
    keys, n = [], len(prints)
    for start in range(SEGMENTS):
        for name, (a, b) in enumerate(((2, 3), (2, 4), (3, 4))):
            four = [seg[:, (start + k) % 8] for k in (0, 1, a, b)]
            keys.append(np.uint64((start * 3 + name) << 32) | four[0] << np.uint64(24) | four[1] << np.uint64(16) | four[2] << np.uint64(8) | four[3])
    return np.concatenate(keys).view(np.int64), np.tile(np.arange(n), len(keys))


def in_ring(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have a start from which all runs keep to their budgets; at 8 segments that includes the whole distance."""
    diff = np.bitwise_count((a ^ b).view(np.uint8)).reshape(-1, 8).astype(np.int16)
    ok = np.zeros(len(a), dtype=bool)
    budget = np.array([LIMIT * k // SEGMENTS for k in range(1, SEGMENTS + 1)])
    for start in range(SEGMENTS):
        ok |= (np.cumsum(np.roll(diff, -start, axis=1), axis=1) <= budget).all(axis=1)
    return ok


def _ring_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        keys, place = ring_rows(prints)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[place].view(np.int64))], ["key", "fp"])


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one key: a spanning set, not all pairs. Rows are sorted by key; all groups go together, by offset."""
    left, right = [], []
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = sizes <= 64
    inside = np.repeat(np.where(small, sizes, 1), sizes) > 1
    k, p = keys[inside], prints[inside]
    for gap in range(1, int(sizes[small].max(initial=1))):
        same = np.flatnonzero(k[gap:] == k[:-gap])
        if not len(same):
            break
        a, b = p[same], p[same + gap]
        near = in_ring(a, b)
        left.append(a[near])
        right.append(b[near])
    for s, size in zip(starts[~small], sizes[~small], strict=True):
        a, b = _spanning(prints[s : s + size])
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group: at most a link per member, found by growing components breadth-first."""
    rest, left, right = np.arange(len(prints)), [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = in_ring(np.full(len(rest), prints[at]), prints[rest])
            found = rest[near]
            left.append(np.full(len(found), prints[at]))
            right.append(prints[found])
            front.extend(found.tolist())
            rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links of groups up to GROUP (linked true), the rows of larger groups as they are (linked false)."""

    def out(a, b, linked: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), linked))], ["a", "b", "linked"])

    keys, prints, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for b in batches:
        keys = np.concatenate([keys, b.column("key").to_numpy()])
        prints = np.concatenate([prints, b.column("fp").to_numpy().view(np.uint64)])
        if hot is not None:  # the rest of a group that is larger than GROUP
            own = keys == hot
            if own.any():
                yield out(keys[own], prints[own], False)
            if own.all():
                keys, prints = keys[:0], prints[:0]
                continue
            keys, prints, hot = keys[~own], prints[~own], None
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield from _settle(keys[:last], prints[:last], out)
            keys, prints = keys[last:], prints[last:]
        if len(keys) > GROUP:
            hot = keys[0]
            yield out(keys, prints, False)
            keys, prints = keys[:0], prints[:0]
    if len(keys):
        yield from _settle(keys, prints, out)


def _settle(keys: np.ndarray, prints: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)])
    large = np.repeat(sizes > GROUP, sizes)
    if large.any():
        yield out(keys[large], prints[large], False)
    a, b = _links(keys[~large], prints[~large])
    if len(a):
        yield out(a, b, True)


def refine_rows(keys: np.ndarray, prints: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Finer keys for the rows of large groups, one array for each choice, which leave out no pair within 3 bits.

    The whole fingerprint is cut into 4 + 4 * level pieces; three differing bits spoil at most three pieces, so a pair agrees on all
    pieces but some three. A key is a hash of the left-out three, the other pieces and the group's key.
    """
    pieces = 4 + 4 * level
    bounds = np.linspace(0, 64, pieces + 1).astype(int)
    with np.errstate(over="ignore"):
        for i, left in enumerate(combinations(range(pieces), LIMIT)):
            mask = sum(((1 << int(bounds[k + 1] - bounds[k])) - 1) << int(bounds[k]) for k in range(pieces) if k not in left)
            mixed = (prints & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) ^ keys.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i)).view(np.int64)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Columns a and b: links that join the same fingerprints as all pairs within 3 bits do. distinct: column fp without repeats.

    Candidates share a ring key. A task compares the groups of its keys as they come sorted, and holds no more than GROUP rows of one key;
    larger groups come back under finer keys, round after round, until every group fits (with all 64 bits in single pieces a key leaves
    at most 8 fingerprints). Within a group over 64 rows only a spanning forest is emitted, never all pairs.
    """
    rows, links, level = distinct.mapInArrow(lean(_ring_keys), "key long, fp long"), None, 0
    while True:
        compared = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_compare), "a long, b long, linked boolean")
        compared = materialize(compared, "simhash-links")
        found = compared.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        large = compared.where("not linked")
        if large.isEmpty():
            return links
        level += 1

        def finer(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                prints = b.column("b").to_numpy()
                for keys in refine_rows(b.column("a").to_numpy(), prints.view(np.uint64), min(level, 15)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints)], ["key", "fp"])

        rows = large.mapInArrow(lean(finer), "key long, fp long")


def digest_components(docs: DataFrame) -> DataFrame:
    """Operator 8. One row per document: doc_id, fp (long), component_id: the smallest doc_id that links of at most 3 differing bits reach.

    Equal fingerprints are folded to their smallest doc_id before any comparison, so exact copies cost one row. Null and empty texts have
    fingerprint 0 and link like any other; repeated rows keep their rows; a null doc_id is never the smallest unless alone; an empty table
    gives no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash-prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-least")
    members = connected_components(link_fingerprints(least.select("fp")), "simhash-components")
    lowest = members.withColumnRenamed("node", "fp").join(least, "fp")
    classes = lowest.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = materialize(lowest.select("fp", "component").join(classes, "component").select("fp", "component_id"), "simhash-classes")
    known = least.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id"))
    return join_unique(prints, known, "fp", prints.count()).select("doc_id", "fp", "component_id")


def print_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): nodes of sets that fingerprints of at most LIMIT differing bits join, as a spanning set of pairs."""
    prints = materialize(sets.where("fp is not null").select("fp", "node").distinct(), "copies-prints")
    least = prints.groupBy("fp").agg(F.min("node").alias("least"))
    same = prints.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = link_fingerprints(prints.select("fp").distinct())
    for side in "ab":
        links = links.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}")), side)
    return same.unionByName(links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _placed(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), rows (how many) and component of near copies, for each distinct pair of the first two.

    SimHash fingerprints of the five-word shingles find most near copies first, by the ring of segments; each such pair is confirmed by
    its whole sets. Similar sets whose fingerprints differ in more bits are then found by prefixes, among the components left.
    """
    sets = materialize(near_copies.shingle_sets(docs).withColumn("row", F.monotonically_increasing_id()), "copies-rows", **near_copies.SMALL)
    own = sets.groupBy("node", "_id", "_hash").agg(F.count("*").alias("rows"))
    near = near_copies.confirm(sets, print_pairs(sets))
    placed = own.join(near_copies.link_sets(sets, near), "node", "left")
    return materialize(placed.select("_id", "_hash", "rows", F.coalesce("component", "node").alias("component")), "copies-placed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The rule of the near-duplicates stage, not operator 8's. One row per document: doc_id and component_id, the smallest doc_id that
    links of five-word Jaccard 0.8 or more reach (near_copies); null if there is none."""
    placed = _placed(docs)
    least = placed.groupBy("component").agg(F.min("_id").alias("component_id"))
    return placed.join(least, "component").select(F.col("_id").alias("doc_id"), "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row")).drop("_row")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies, as near_duplicates gives them.

    The row of the smallest doc_id stays (null last), of equal doc_ids the first by the text's hash. Rows are known by doc_id and text, so
    a doc_id with several texts is decided text by text, and rows without one fold like others. What is joined to the texts are the rows
    that go, the fewer.
    """
    placed, place = _placed(docs), F.struct(F.col("_id").isNull(), "_id", "_hash")
    best = placed.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("rows"))
    judged = materialize(join_unique(placed, best, "component", placed.count()).select("_id", "_hash", "rows", (place == F.col("best")).alias("stays")).where("not stays or rows > 1"), "copies-gone")
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_kept"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_text"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    rows = kept.join(judged.where("not stays"), same, "left_anti")
    repeated = judged.where("stays").select("_id", "_hash")
    if repeated.isEmpty():
        return rows.select("_kept.*")
    folded = rows.join(repeated, same, "left_semi").groupBy("_own", "_text").agg(F.first("_kept").alias("_kept"))
    return rows.join(repeated, same, "left_anti").select("_kept").unionByName(folded.select("_kept")).select("_kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_components(read_table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
