"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, read_table, release_memory, ship

#: Bytes of a filter, step between its places, filters, bytes of a chunk and by how many the next one overlaps it.
WIDTH, STRIDE, FILTERS, CHUNK, OVERLAP = 6, 2, 24, 512, 64
#: Bounds of the training sample (labelled rows, chosen by hash of doc_id, and bytes of their whole texts).
SAMPLE, SAMPLE_BYTES = 4000, 24_000_000
#: Steps that training should take, in no fewer and no more passes than these; texts of a step.
STEPS, PASSES, TOGETHER = 1200, (18, 40), 64
THRESHOLD = 0.7
#: Bytes that a worker scores at a time, and chunks that training holds at a time.
SLAB, STEP = 1 << 20, 256


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 4 == 2


def chunk_places(length: int) -> np.ndarray:
    """Starts of the chunks that cover a text: each but the first overlaps the one before it."""
    step = CHUNK - OVERLAP
    return np.arange(max(1, -(-(length - OVERLAP) // step))) * step


def chunks_of(text: bytes) -> np.ndarray:
    """The chunks of a text as rows of bytes, filled with zeros: a view, so that a long text isn't copied for each chunk."""
    n = len(chunk_places(len(text)))
    buffer = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    buffer[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(buffer, (n, CHUNK), (CHUNK - OVERLAP, 1), writeable=False)


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of all texts, chunks of each)."""
    rows = [chunks_of(t) for t in texts]
    return rows[0] if len(rows) == 1 else np.concatenate(rows), np.array([len(x) for x in rows])


class Network:
    """filters: (WIDTH, 256, FILTERS) by place and byte; their maxima over a chunk are its features, and a text's features are the mean
    and the maximum of those of its chunks, combined linearly into a log-odds."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.top, self.offset]

    def pair_tables(self) -> list[np.ndarray]:
        """For two neighbouring bytes at once: half the lookups. Read as little-endian 16-bit numbers, the first byte is the lower."""
        return [(self.filters[k + 1][:, None, :] + self.filters[k][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def chunk_features(self, chunks: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The maximum of each filter over all its places in each chunk, at least 0."""
        tables = tables or self.pair_tables()
        out = np.empty((len(chunks), FILTERS), np.float32)
        step = max(1, SLAB // CHUNK // 4)
        for at in range(0, len(chunks), step):
            pairs = np.ascontiguousarray(chunks[at : at + step]).view("<u2")  # STRIDE is 2: a filter starts at every pair
            n = pairs.shape[1] - len(tables) + 1
            total = tables[0][pairs[:, :n]]
            for k in range(1, len(tables)):
                total += tables[k][pairs[:, k : k + n]]
            out[at : at + step] = total.max(axis=1)
        return np.maximum(out + self.bias, 0)

    def combine(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(features, starts, axis=0) / counts[:, None]
        return np.concatenate([mean, np.maximum.reduceat(features, starts, axis=0)], axis=1)

    def scores(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        """A probability for each whole text; an empty one has a single chunk of zeros."""
        if not texts:
            return np.zeros(0)
        chunks, counts = chunked(texts)
        logits = self.combine(self.chunk_features(chunks, tables), counts).astype(np.float64) @ self.top + self.offset[0]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def train(texts: list[bytes], labels: list[int], epochs: int | None = None, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on the log loss over whole texts; a rarer good class would weigh down the others. Deterministic for the same rows in the same
    order. Chunks go through the filters in slabs of STEP, so that memory doesn't grow with a text."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    epochs = epochs or int(np.clip(STEPS // (len(y) // TOGETHER + 1), *PASSES))
    if not len(y):
        return net
    share = float(np.clip(y.mean(), 0.02, 0.98))
    weight = np.where(y > 0, 1, min(1.0, share / (1 - share)) ** 0.5).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    r, step = np.random.default_rng(seed), 0
    places = (CHUNK - WIDTH) // STRIDE + 1
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            x, own = chunked([texts[i] for i in some])
            raw, best = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int32)
            for s in range(0, len(x), STEP):
                part = x[s : s + STEP]
                total = net.filters[0][part[:, 0 : 2 * places : STRIDE]]
                for k in range(1, WIDTH):
                    total += net.filters[k][part[:, k : k + 2 * places - 1 : STRIDE]]
                best[s : s + STEP] = total.argmax(axis=1)
                raw[s : s + STEP] = total.max(axis=1) + net.bias
            features = np.maximum(raw, 0)
            pooled = net.combine(features, own)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.top + net.offset[0], -30, 30)))
            d = (p - y[some]) * weight[some] / len(some)
            gradient_top = pooled.T @ d + 1e-4 * net.top
            d_mean = np.repeat(d / own, own)[:, None] * net.top[:FILTERS]
            high = np.repeat(pooled[:, FILTERS:], own, axis=0)
            d_high = np.where(features == high, np.repeat(d, own)[:, None] * net.top[FILTERS:], 0)
            d_raw = np.where(raw > 0, d_mean + d_high, 0).astype(np.float32)
            gradient = np.zeros_like(net.filters)
            column = np.arange(FILTERS)[None, :]
            for s in range(0, len(x), STEP):
                part = slice(s, s + STEP)
                chunk = np.arange(len(x[part]))[:, None]
                for k in range(WIDTH):
                    np.add.at(gradient[k], (x[part][chunk, best[part] * STRIDE + k], np.broadcast_to(column, best[part].shape)), d_raw[part])
            step += 1
            speed = rate * (1 - epoch / epochs)
            for p_, g, (m, v) in zip(net.parameters(), (gradient, d_raw.sum(axis=0), gradient_top.astype(np.float32), np.array([d.sum()], np.float32)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Network:
    """Trains on at most sample labelled rows whose crc32(doc_id as text) mod 4 is not 2, the first by hash of doc_id, whole texts.

    Rows whose texts would bring the sum over `most` bytes are passed over, so that no more comes to the driver. Null labels and ids don't
    count, null texts are empty. Without any row the network gives 0.5 for every text; with one class it learns that.
    """
    ship(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit(11))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    chosen = usable.withColumn("_order", order).orderBy("_order", "doc_id", "quality").limit(sample)
    # at most `sample` rows of three numbers: a proven bound for the broadcast
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    # running sums over no more rows than the sample; larger texts stay in the executors
    first = joined.select("_order", "doc_id", "quality", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"), "text").where(F.col("size") <= most).orderBy("_order", "doc_id", "quality", "size", "hash").limit(sample)
    before = F.sum("size").over(Window.orderBy("_order", "doc_id", "quality", "size", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = first.withColumn("sum", before).where(F.col("sum") <= most).orderBy("_order", "doc_id", "quality", "size", "hash").collect()
    texts, marks = [r["text"].encode("utf-8", "surrogatepass") for r in rows], [r["quality"] for r in rows]
    del rows
    net = train(texts, marks)
    if not texts:
        net.top[:] = 0
    del texts
    release_memory()
    return net


def _score_batches(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their scores, some MB of text at a time; a very long text goes through the network in slabs of chunks."""
    tables = net.pair_tables()
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
        scores, start, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLAB * 4 or i + 1 == len(texts):
                scores.append(net.scores(texts[start : i + 1], tables))
                start, size = i + 1, 0
        yield b, np.concatenate(scores) if scores else np.zeros(0)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on).

    Nothing but the text's bytes is an input. No shuffle. Null texts count as empty and get a score too; repeated rows score alike; a null
    doc_id is not held out; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, scores in _score_batches(net, batches):
            ids = b.column("doc_id")
            held = pa.array([is_held_out(i) for i in ids.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """docs without those that score under THRESHOLD, in their own columns.

    Null texts are judged as empty ones; repeated rows stay or go alike; an empty table gives no rows; other columns are kept as they are.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, scores in _score_batches(net, batches):
            yield b.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
