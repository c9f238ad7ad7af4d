"""LM scoring: a bigram model with absolute discounting as a weighted backoff automaton, its counts kept in shards and fetched per batch of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, read_table, ship

#: Bytes of text that one batch of documents holds, and of all text for each shard of counts.
BATCH_BYTES, SHARD_BYTES = 16_000_000, 24_000_000
#: A word is hot from this share of all training tokens and this count on; its continuations are dealt over all shards.
HOT_SHARE, HOT_COUNT = 0.01, 1000
#: Bits of a continuation's hash within its history.
NEXT_BITS = 40
#: White space can't be in a word, so these two are free for the end of a text and its start.
END, START = b" ", b"\n"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of a history and a continuation."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, compressed."""
    import zstandard

    delta = np.diff(keys, prepend=keys[:1])
    if len(keys):
        delta[0] = keys[0]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def expand_keys(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers in byte planes, compressed."""
    import zstandard

    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide).tobytes())


def expand(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def squeeze_next(nexts: np.ndarray) -> bytes:
    """Continuations' hashes in their NEXT_BITS // 8 byte planes; they are random, so nothing is compressed."""
    return np.ascontiguousarray(nexts.astype("<u8").view(np.uint8).reshape(-1, 8).T[: NEXT_BITS // 8]).tobytes()


def expand_next(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(NEXT_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : NEXT_BITS // 8] = planes.T
    return out.view("<u8").ravel()


class Batch:
    """Documents as token numbers of a vocabulary of their own."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {END: 0, START: 1}
        self.doc_ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        known = self.words
        words = text.lower().split()
        places = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.doc_ids.append(doc_id)
        self.tokens.append(np.append(places, np.int32(0)))
        self.size += len(text) + 64

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(word hashes, sorted; every token as the place of its hash; tokens of each document; the place of the start's hash)."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        order = np.argsort(hashes)
        place = np.empty(len(hashes), np.int32)
        place[order] = np.arange(len(hashes), dtype=np.int32)
        return hashes[order], place[np.concatenate(self.tokens)], np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)), int(place[1])


class Pairs:
    """The distinct pairs of a token and the one before it, sorted by history and continuation, as places of words sorted by hash."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, start: int):
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(lengths) - lengths] = start
        pair = before.astype(np.int64) << 32 | tokens
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.r_[True, pair[1:] != pair[:-1]]
        self.place = np.empty(len(tokens), np.int32)
        self.place[order] = (np.cumsum(first) - 1).astype(np.int32)
        distinct = pair[first]
        self.words, self.history, self.next = words, distinct >> 32, (distinct & 0xFFFFFFFF).astype(np.int32)
        self.bounds = np.searchsorted(self.history, np.arange(len(words) + 1))

    def next_hashes(self) -> np.ndarray:
        """The upper bits of the continuations' hashes: they rise with the words' places, so they are sorted within a history."""
        return self.words[self.next] >> np.uint64(64 - NEXT_BITS)

    def cuts(self, shards: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard: its histories' places, how many continuations of each go there, and these pairs' places.

        A shard has a range of the histories' hashes, without the hot ones, and a range of the hot ones' continuations.
        """
        low = shard_bounds(shards)
        hot_places = np.flatnonzero(np.isin(self.words, hot))
        cold = np.ones(len(self.words), bool)
        cold[hot_places] = False
        edges = np.r_[np.searchsorted(self.words, low), len(self.words)]
        sizes = np.diff(self.bounds)
        nexts = self.next_hashes()
        inside = [self.bounds[h] + np.r_[np.searchsorted(nexts[self.bounds[h] : self.bounds[h + 1]], low >> np.uint64(64 - NEXT_BITS)), sizes[h]] for h in hot_places]
        for s in range(shards):
            own = np.arange(edges[s], edges[s + 1])
            own = own[cold[own]]
            pairs = np.arange(self.bounds[edges[s]], self.bounds[edges[s + 1]])
            pairs = pairs[cold[self.history[pairs]]]
            parts = [np.arange(x[s], x[s + 1]) for x in inside]
            yield s, np.r_[own, hot_places], np.r_[sizes[own], [len(x) for x in parts]].astype(np.int64), np.concatenate([pairs, *parts]).astype(np.int64)


def shard_bounds(shards: int) -> np.ndarray:
    """The lowest key of each shard: equal ranges of the 64-bit hashes."""
    return np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)


BATCHES = "batch long, doc_ids array<long>, lengths binary, tokens binary, words binary, start long, bytes long, trained long, common array<struct<word:long,n:long>>"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents as token numbers, a row each, with the training counts of the words that may be hot."""
    common = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("lengths", "tokens", "words")), *((c, pa.int64()) for c in ("start", "bytes", "trained")), ("common", common)])
    task, number, batch = TaskContext.get(), 0, Batch()

    def row() -> pa.RecordBatch:
        words, tokens, lengths, start = batch.numbered()
        used = np.array([not is_held_out(d) for d in batch.doc_ids])
        counts = np.bincount(tokens[np.repeat(used, lengths)], minlength=len(words))
        counts[start] = used.sum()
        often = np.flatnonzero(counts >= max(1, HOT_SHARE / 2 * counts.sum()))
        return pa.RecordBatch.from_pylist([{
            "batch": task.partitionId() << 24 | number, "doc_ids": batch.doc_ids, "lengths": squeeze(lengths), "tokens": squeeze(tokens), "words": squeeze_keys(words), "start": start,
            "bytes": batch.size, "trained": int(lengths[used].sum()), "common": [{"word": w, "n": n} for w, n in zip(words[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)],
        }], schema)

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
            batch.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
            if batch.size >= BATCH_BYTES:
                yield row()
                number, batch = number + 1, Batch()
    if batch.doc_ids:
        yield row()


def _opened(row: dict) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """(pairs, tokens, lengths) of a row of BATCHES."""
    lengths, tokens = expand(row["lengths"]), expand(row["tokens"]).astype(np.int32)
    return Pairs(expand_keys(row["words"]), tokens, lengths, row["start"]), tokens, lengths


REQUESTS = "batch long, shard int, histories binary, sizes binary, nexts binary, counts binary"


def _ask(shards: int, hot: np.ndarray):
    """For each batch and shard the pairs that fall to it, with their training counts."""
    schema = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("histories", "sizes", "nexts", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                pairs, tokens, lengths = _opened(r)
                used = np.repeat(np.array([not is_held_out(d) for d in r["doc_ids"]]), lengths)
                counts = np.bincount(pairs.place[used], minlength=len(pairs.next))
                nexts = pairs.next_hashes()
                for s, own, sizes, some in pairs.cuts(shards, hot):
                    yield pa.RecordBatch.from_pylist([{"batch": r["batch"], "shard": s, "histories": squeeze_keys(pairs.words[own]), "sizes": squeeze(sizes), "nexts": squeeze_next(nexts[some]), "counts": squeeze(counts[some])}], schema)

    return run


ANSWERS = "batch long, shard int, totals binary, kinds binary, counts binary, tokens long, distinct long, once long, twice long, pair_once long, pair_twice long"


def _count(hot: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard: sums the counts of each pair over all batches, and answers each batch in the order of its request with the counts
        of its pairs, and of each history the sum of all its pairs' counts (total) and their number (kinds)."""
        asked: list[tuple[int, bytes, bytes, bytes]] = []
        keys, owners, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        weight = 0

        def settle() -> None:
            nonlocal keys, owners, counts, pending, weight
            if pending:
                k, h, n = (np.concatenate(c) for c in zip((keys, owners, counts), *pending, strict=True))
                order = np.argsort(k)
                k = k[order]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
                keys, owners = k[first], h[order][first]
                counts = np.add.reduceat(n[order], first) if len(first) else n
                pending, weight = [], 0

        def named(histories: bytes, sizes: bytes, nexts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = expand_keys(histories)
            each = np.repeat(own, expand(sizes))
            return own, each, mix(each, expand_next(nexts))

        for b in table:
            for r in b.to_pylist():
                asked.append((r["batch"], r["histories"], r["sizes"], r["nexts"]))
                _, each, pairs = named(*asked[-1][1:])
                n = expand(r["counts"])
                used = n > 0
                pending.append((pairs[used], each[used], n[used]))
                weight += int(used.sum())
                if weight > max(2_000_000, len(keys)):
                    settle()
        settle()
        order = np.argsort(owners)
        sorted_owners = owners[order]
        first = np.flatnonzero(np.r_[True, sorted_owners[1:] != sorted_owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
        known = sorted_owners[first]
        totals = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        kinds = np.diff(np.r_[first, len(owners)])
        cold = totals[~np.isin(known, hot)]
        stats = {"tokens": int(counts.sum()), "distinct": len(cold), "once": int((cold == 1).sum()), "twice": int((cold == 2).sum()), "pair_once": int((counts == 1).sum()), "pair_twice": int((counts == 2).sum())}

        def look(have: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[bytes]:
            if not len(have):
                return [squeeze(np.zeros(len(wanted), np.int64)) for _ in values]
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            found = have[at] == wanted
            return [squeeze(np.where(found, v[at], 0)) for v in values]

        shard = key[0].as_py()
        for i, (batch, *request) in enumerate(asked):
            own, _, pairs = named(*request)
            blobs = look(known, own, totals, kinds) + look(keys, pairs, counts)
            numbers = stats if i == 0 else dict.fromkeys(stats, 0)
            yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int64()), "shard": pa.array([shard], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in zip(("totals", "kinds", "counts"), blobs, strict=True)}, **{k: pa.array([v], pa.int64()) for k, v in numbers.items()}})

    return run


def discount_of(once: int, twice: int) -> float:
    """What an n-gram that was seen loses to those that weren't, from how many were seen once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


class Automaton:
    """The part of the model that a batch can reach.

    States are the histories seen in training (a word, or the start of a text) and the empty history. Every pair seen in training is an
    arc of its history's state, with its smoothed probability; words seen in training are arcs of the empty state, and one more arc stands
    for all others. A failure arc leads from a word's state to the empty one; its weight is what the discount D took from the state's
    arcs, D * kinds / total. An arc weighs (count - D) / total plus the failure weight times its word's arc, so a state's arcs and failures
    sum to 1. Reading a token leads to its word's state, or to the empty one if the word was never a history.
    """

    EMPTY = -1

    def __init__(self, totals: np.ndarray, kinds: np.ndarray, pair_counts: np.ndarray, pairs: Pairs, stats: dict, start: int, end: int):
        self.known = totals.copy()
        self.known[end], self.known[start] = totals[start], 0
        n, v = stats["tokens"], stats["distinct"]
        lost = discount_of(stats["once"], stats["twice"])
        word = np.where(self.known > 0, (np.maximum(self.known, 1) - lost) / max(n, 1), lost * v / n if n else 1.0)
        d = discount_of(stats["pair_once"], stats["pair_twice"])
        left = d * kinds / np.maximum(totals, 1)
        self.start = start
        self.state = np.where(totals > 0, np.arange(len(totals)), self.EMPTY)
        self.word = np.log10(word)
        self.failure = np.log10(np.where(totals > 0, left, 1.0))
        self.is_arc = pair_counts > 0
        h = pairs.history
        self.arc = np.log10(np.where(self.is_arc, (pair_counts - d) / np.maximum(totals[h], 1) + left[h] * word[pairs.next], 1.0))

    def traverse(self, tokens: np.ndarray, arcs: np.ndarray) -> float:
        """The text's log-probability, from left to right: each token takes its arc out of the state that the one before it led to, or
        that state's failure arc and then the token's arc out of the empty state. arcs: the place of each token's pair."""
        states = self.state[np.concatenate([[self.start], tokens[:-1]])]
        taken = self.is_arc[arcs]
        fails = ~taken & (states != self.EMPTY)
        return float(self.arc[arcs[taken]].sum() + self.failure[states[fails]].sum() + self.word[tokens[~taken]].sum())


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(stats: dict, shards: int, hot: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {r["shard"]: r for r in right.select(["shard", "totals", "kinds", "counts"]).to_pylist()}
        n, v = stats["tokens"], stats["distinct"]
        out: dict[str, list] = {k.split()[0]: [] for k in SCORES.split(", ")}
        for r in left.to_pylist():
            pairs, tokens, lengths = _opened(r)
            totals, kinds, counts = np.zeros(len(pairs.words), np.int64), np.zeros(len(pairs.words), np.int64), np.zeros(len(pairs.next), np.int64)
            for s, own, _, some in pairs.cuts(shards, hot):
                a = answers[s]
                # a hot history has a part in every shard
                totals[own] += expand(a["totals"])
                kinds[own] += expand(a["kinds"])
                counts[some] = expand(a["counts"])
            end = int(np.flatnonzero(pairs.words == np.uint64(xxhash.xxh64_intdigest(END)))[0])
            model = Automaton(totals, kinds, counts, pairs, stats, r["start"], end)
            base = np.log10((model.known + 1) / (n + v + 1))
            ends = np.cumsum(lengths)
            for doc_id, a, z in zip(r["doc_ids"], np.r_[0, ends[:-1]], ends, strict=True):
                t = tokens[a:z]
                row = doc_id, is_held_out(doc_id), len(t), int((model.known[t] > 0).sum()), n, float(base[t].sum()), model.traverse(t, pairs.place[a:z])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], list(out))

    return run


def score_documents(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    1. Batches of documents become token numbers where they are read; they are written once, so that all later steps see the same batches.
    2. Each batch asks the shards of its histories' hash ranges for its distinct pairs of words, and tells them its training counts.
    3. Each shard sums all batches' training counts (nothing is pruned or capped) and answers each batch with the totals of its pairs and
       histories. Shards grow in number with the text, so that a shard's work doesn't grow with it.
    4. Each batch builds the states and arcs it needs and scores its documents in one traversal each.
    A frequent pair costs a row's part for each batch. The continuations of a hot word (HOT_SHARE of all training tokens, so there are few)
    are dealt over all shards. Words are known by 64-bit hashes, continuations by NEXT_BITS bits within their history. Null and empty texts
    are the end token alone; a null doc_id counts as an empty text for its checksum; repeated rows count and score each; without training
    tokens all words share the one unknown arc; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    batches = materialize(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(_number), BATCHES), "lm-batches")
    size = batches.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("trained"), F.lit(0)).alias("trained")).first()
    often = batches.select(F.explode("common").alias("c")).groupBy("c.word").agg(F.sum("c.n").alias("n")).where(F.col("n") >= max(HOT_COUNT, HOT_SHARE * size["trained"]))
    # no more than 1 / HOT_SHARE words, and the start, can have that share
    hot = np.sort(np.array([r["word"] for r in often.collect()], np.int64).view(np.uint64))
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // SHARD_BYTES))
    asked = batches.mapInArrow(lean(_ask(shards, hot)), REQUESTS)
    answers = materialize(asked.groupBy("shard").applyInArrow(_count(hot), ANSWERS), "lm-answers")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "once", "twice", "pair_once", "pair_twice")]).first().asDict()
    sums["distinct"] += len(hot)
    left = batches.select("batch", "doc_ids", "lengths", "tokens", "words", "start")
    right = answers.select("batch", "shard", "totals", "kinds", "counts")
    return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_score(sums, shards, hot), SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
