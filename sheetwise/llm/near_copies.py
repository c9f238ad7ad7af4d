"""Near copies by word shingles: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, materialize, remove_work, ship, work_mark

SHINGLE = 5
#: The similarity of a link as a fraction, 4 / 5.
PART, WHOLE = 4, 5
#: Cells that count how common shingles are, and how far above a task's mean a cell is reported.
CELL_BITS, COMMON = 20, 4
#: Members of each group that are compared with all others, round by round; None stands for all. Before the last round a set is compared
#: with one other only.
HUBS = (1, 8, None)
SEEN = 200_000
#: Writers of whole sets hold no more than this; the hashes have nothing that a dictionary could save.
SMALL = {"parquet.block.size": 8 << 20, "parquet.enable.dictionary": "false"}
#: Bits of a shingle's hash: of two texts' shingles no two different ones have one hash but by a chance of some 1e-8.
HASH_BITS = 48
#: Least bits of a sketch, those of the short one that goes with each row of a group, and pairs whose sets meet in one task.
SKETCH, SHORT, TOGETHER = 1024, 128, 64
#: Columns of a group's rows: the key, the set, its size, the key's place in it, and the two halves of the short sketch.
ROW = ("key", "node", "n", "place", "s0", "s1")


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the lower-cased words (all words if fewer, also if none)."""
    words = text.lower().split()
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = set(map(join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))) if len(words) >= SHINGLE else {join(words)}
    return np.unique(np.fromiter(map(digest, shingles), np.uint64, len(shingles)) >> np.uint64(64 - HASH_BITS))


def squeeze_set(shingles: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte plane by byte plane."""
    delta = np.diff(shingles, prepend=np.uint64(0))
    return np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8).T[: HASH_BITS // 8]).tobytes()


def expand_set(blob) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(HASH_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : HASH_BITS // 8] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of how many shingles fall into each bit: two sets differ in at least as many shingles as their sketches do in bits.

    There are two bits for a shingle or more, a power of two, so that the sketches of unlike sets differ in more bits than similar ones may.
    """
    bits = max(SKETCH, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def short_sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketch folded to SHORT bits, as two longs."""
    return np.packbits(np.bincount((shingles & np.uint64(SHORT - 1)).astype(np.int64), minlength=SHORT) & 1).view(np.int64)


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the other's length, which keeps parities."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def xxh_spread(shingles: np.ndarray) -> np.ndarray:
    """64 mixed bits of each hash."""
    x = shingles * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        nodes, sets, sketches, prints = [], [], [], []
        for t in b.column("text").cast(pa.large_binary()):
            shingles = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")
            own = squeeze_set(shingles)
            node = xxhash.xxh64_intdigest(own)
            sets.append(None if node in seen else own)
            sketches.append(None if node in seen else sketch(shingles))
            prints.append(None if node in seen else np.uint64(majority(xxh_spread(shingles))).view(np.int64))
            nodes.append(node)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_hash"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), pa.array(prints, pa.int64())], ["_id", "_hash", "node", "shingles", "sketch", "fp"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), node (of the set), shingles, sketch and SimHash fingerprint (fp) for each row; within a task a set is given once, and the last three are null in its repeats."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    return rows.mapInArrow(lean(_sets), "_id long, _hash long, node long, shingles binary, sketch binary, fp long")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for b in batches:
        for s in b.column("shingles"):
            cells = expand_set(s.as_buffer()) >> np.uint64(HASH_BITS - CELL_BITS)
            np.add.at(counts, cells.astype(np.int64), 1)
    cells = np.flatnonzero(counts > COMMON * (4 + counts.mean()))
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order of rising counts of their cells, then by hash: two sets that are similar enough share one of them."""
    n = len(shingles)
    order = np.argsort(counts[(shingles >> np.uint64(HASH_BITS - CELL_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[: n - -(-PART * n // WHOLE) + 1]]


def possible(n: np.ndarray, place: np.ndarray, m, at) -> np.ndarray:
    """Whether sets of n and m shingles whose first shared one is at these places can be similar enough."""
    return (PART + WHOLE) * np.minimum(n - place, m - at) >= PART * (n + m)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Runs of whole groups from rows sorted by key, as columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy() for c in names]
        start = int(np.searchsorted(new[0], new[0][-1]))
        if held and new[0][0] != held[-1][0][-1]:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if start:
            held.append([c[:start] for c in new])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[start:] for c in new])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of groups with two sets or more, one row for each set."""
    for columns in _groups(batches, ROW):
        order = np.lexsort((columns[1], columns[0]))
        key, node = columns[0][order], columns[1][order]
        order = order[np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]]
        key = columns[0][order]
        same = key[1:] == key[:-1]
        kept = order[np.r_[False, same] | np.r_[same, False]]
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], list(ROW))


def _pairs(start: int, stop: int | None):
    """Pairs of the members start to stop of each group with all later ones, if not in one component and possible by size, place and short
    sketch: copies of one text that differ among themselves share their prefixes, and would otherwise all be paired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, (*ROW, "component")):
            order = np.lexsort((columns[1], columns[0]))
            key, node, n, place, s0, s1, component = [c[order] for c in columns]
            n, place, s0, s1 = n.astype(np.int64), place.astype(np.int64), s0.view(np.uint64), s1.view(np.uint64)  # only unsigned bits are counted as they stand
            bounds = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            left, right = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (component[s:e] == component[s]).all():
                    continue
                for i in range(s + start, e - 1 if stop is None else min(s + stop, e - 1)):
                    rest = slice(i + 1, e)
                    differ = np.bitwise_count(s0[rest] ^ s0[i]).astype(np.int64) + np.bitwise_count(s1[rest] ^ s1[i])
                    few = (WHOLE + PART) * differ <= (WHOLE - PART) * (n[rest] + n[i])
                    near = node[rest][(component[rest] != component[i]) & few & possible(n[rest], place[rest], n[i], place[i])]
                    left.append(np.full(len(near), node[i]))
                    right.append(near)
                if sum(map(len, left[-64:])) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                    left, right = [], []
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def _not_excluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches differ in no more bits than similar sets differ in shingles."""
    for b in batches:
        if not b.num_rows:
            continue
        differ = np.array([sketches_differ(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("ka"), b.column("kb"), strict=True)], np.int64)
        size = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((WHOLE + PART) * differ <= (WHOLE - PART) * size))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * shared >= PART * (len(a) + len(b) - shared)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, part and kind: the set of a (kind 0), and then the sets that it is compared with, one at a time."""
    at, held = None, None
    for b in batches:
        found = []
        for a, part, kind, node, blob in zip(*(b.column(c).to_pylist() for c in ("a", "part", "kind", "node")), b.column("shingles"), strict=True):
            if kind == 0:
                at, held = (a, part), expand_set(blob.as_buffer())
            elif at == (a, part) and similar(held, expand_set(blob.as_buffer())):
                found.append((a, node))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with these columns of both nodes, each named by its first letter and the side."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(c[0] + side) for c in columns]), side)
    return pairs


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose whole sets are similar enough.

    The set of a goes once to each part of some TOGETHER of its pairs, and the other sets come to it; of equal sets one row is read.
    """
    pairs = materialize(pairs, "copies-pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    both = dealt.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("node")).distinct().unionByName(dealt.select("a", "part", F.lit(1).alias("kind"), F.col("b").alias("node")))
    first = sets.where("shingles is not null").groupBy("node").agg(F.min("row").alias("row"))
    wanted = materialize(both.join(first, "node"), "copies-wanted")
    rows = sets.select("node", "row", "shingles").join(wanted, ["node", "row"]).select("a", "part", "kind", "node", "shingles")
    met = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(lean(_confirmed), "a long, b long")
    return materialize(met, "copies-links")


def link_sets(sets: DataFrame, known_links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the sets that have a similar one; sets: row, node, shingles and sketch, where repeats are fine.

    Two similar sets share a shingle of their prefixes, whatever order all sets are sorted in; common shingles come last, so that groups
    stay small. In each group first one member meets all others, then eight, then all; pairs that earlier rounds or known_links (a, b)
    joined are left out, so that a large cluster costs few comparisons. Every other pair that sizes, places and sketches allow is compared
    by its whole sets.
    """
    spark = sets.sparkSession
    given = sets.where("shingles is not null").select("node", "shingles")
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    common = given.mapInArrow(lean(_common), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[common["cell"].to_numpy(np.int64)] = np.minimum(common["n"].to_numpy(np.int64), 0xFFFFFFFF)
    shared = spark.sparkContext.broadcast(counts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [expand_set(s.as_buffer()) for s in b.column("shingles")]
            first = [prefix(s, shared.value) for s in own]
            size = np.fromiter(map(len, first), np.int64, len(first))
            if not len(first):
                continue
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            short = np.repeat(np.stack([short_sketch(s) for s in own]), size, axis=0)
            columns = [np.concatenate(first).view(np.int64), np.repeat(b.column("node").to_numpy(), size), np.repeat(np.fromiter(map(len, own), np.int64, len(own)), size).astype(np.int32), place.astype(np.int32), short[:, 0].copy(), short[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(ROW))

    shape = "key long, node long, n int, place int, s0 long, s1 long"
    rows = given.mapInArrow(lean(keys), shape).repartition("key").sortWithinPartitions("key").mapInArrow(lean(_shared), shape)
    groups = materialize(rows, "copies-groups")
    # the nodes are written first: while they are small, Spark broadcasts them, and the sets aren't shuffled
    met = materialize(groups.select("node", "n").distinct(), "copies-nodes")
    sketches = materialize(sets.where("sketch is not null").select("node", "sketch").join(met, "node").dropDuplicates(["node"]), "copies-sketches")

    links, start = known_links, 0
    members = None if links is None else connected_components(links, "copies-components")
    for stop in HUBS:
        mark = work_mark()
        known = groups.withColumn("component", F.col("node")) if members is None else groups.join(members, "node", "left").select(*groups.columns, F.coalesce("component", "node").alias("component"))
        pairs = known.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_pairs(start, stop)), "a long, b long").distinct()
        left = beside(pairs, sketches.withColumnRenamed("sketch", "k"), "k", "n").select("a", "b", "ka", "kb", "na", "nb").mapInArrow(lean(_not_excluded), "a long, b long")
        if stop is not None:
            left = left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = confirm(sets, left)
        remove_work(spark, mark, keep_last=True)
        links = found if links is None else links.union(found)
        members = connected_components(links, "copies-components")
        start = 0
    return members
