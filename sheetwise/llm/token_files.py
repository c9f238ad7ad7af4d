"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialize, read_table, ship

END_ID = 2
MAGIC = b"SWTOK1\0\0"
#: Tokens after which a file is closed, and tokens coded at a time.
FILE_TOKENS, BLOCK = 2_000_000, 1 << 20
#: Documents, and bytes of text, that one range of ids should hold, and the quantiles of ids that ranges are made from.
RANGE_DOCS, RANGE_BYTES, QUANTILES = 8192, 64_000_000, 4096
CACHE = 900_000
#: Ranges whose files one window orders.
GROUP = 1024

#: For each control byte the lengths of its four numbers, and the places of their bytes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
TOTALS = LENGTHS.sum(axis=1).astype(np.int64)
BEFORE = (np.cumsum(LENGTHS, axis=1) - LENGTHS).astype(np.int64)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes): two bits of length for each number, four to a control byte; the last group is filled with zeros."""
    n = np.zeros(-(-len(numbers) // 4) * 4, dtype="<u4")
    n[: len(numbers)] = numbers
    size = 1 + (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    four = (size - 1).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), n.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again, by table lookup of each control byte's lengths and places."""
    c = np.frombuffer(control, np.uint8)
    if not len(c):
        return np.zeros(0, np.uint32)
    start = np.concatenate([[0], np.cumsum(TOTALS[c])[:-1]])
    at = (start[:, None] + BEFORE[c]).ravel()[:count]
    size = LENGTHS[c].ravel()[:count]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: header, ids by falling frequency (ties by id), documents, then control and data bytes of all ranks in blocks."""
    if int(ids.max(initial=0)) < 1 << 22:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        counts, place = counts[values], ids
    else:
        values, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(int(place.max(initial=0)) + 1, dtype=np.uint32)
    rank[values[order] if place is ids else order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank[place]
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(values)))
    out.write(values[order].astype("<u4").tobytes() + doc_ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + lengths.astype("<u8").tobytes())
    for at in range(0, len(ranks), BLOCK):
        control, data = pack(ranks[at : at + BLOCK])
        out.write(struct.pack("<QQ", len(control), len(data)) + control + data)
    return out.getvalue()


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, valid, lengths, ids) of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, distinct = struct.unpack_from("<QQQ", content, 8)
    at, out = 32, []
    for kind, n in (("<u4", distinct), ("<i8", docs), ("u1", docs), ("<u8", docs)):
        out.append(np.frombuffer(content, kind, n, at))
        at += out[-1].nbytes
    table, doc_ids, valid, lengths = out
    ids = np.empty(tokens, np.uint32)
    for done in range(0, tokens, BLOCK):
        n = min(BLOCK, tokens - done)
        c, d = struct.unpack_from("<QQ", content, at)
        at += 16
        ids[done : done + n] = table[unpack(content[at : at + c], content[at + c : at + c + d], n)]
        at += c + d
    return doc_ids, valid.astype(bool), lengths, ids


#: Kinds of bytes: 0 ASCII white space, 1 an ASCII letter, 2 an ASCII mark other than the apostrophe, 3 any other. The tokenizer
#: lower-cases, and never joins text across white space, nor an ASCII letter and a mark beside it.
KIND = np.full(256, 3, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in lower case, number of words of each text): runs without white space, cut between letters and marks."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = KIND[raw]
    inside = kind > 0
    cut = np.ones(len(raw), bool)
    # letter beside mark: the kinds' bits differ in both places
    cut[1:] = ~inside[:-1] | ((kind[1:] ^ kind[:-1]) == 3) & inside[1:]
    starts = np.flatnonzero(inside & cut)
    compact = LOWER[raw[inside]]
    offsets = np.empty(len(starts) + 1, np.int64)
    offsets[:-1] = np.cumsum(inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[starts] - 1
    offsets[-1] = len(compact)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.r_[0, np.searchsorted(starts, ends)])


class _Words(dict):
    """UTF-8 word: its place in the flat store of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # texts are cut at added tokens before words are met; what is left, such as one in upper case, is plain text
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must be matched as they are")
        #: A word for each added token, which no text holds: the byte 255 isn't part of UTF-8.
        self.added = {b"\xff%d" % i: i for i in added}
        marks = {t.content.encode(): b" \xff%d " % i for i, t in added.items()}
        self.names = sorted(marks, key=len, reverse=True)
        self.mark_added = lambda text: any_added(lambda m: marks[m[0]], text)
        any_added = re.compile(b"|".join(map(re.escape, self.names))).sub
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words; those not met before are encoded."""
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            place = self.get(w)
            if place is None:
                self.new.append(w)
                place = self[w] = len(self)
            out[i] = place
        if self.new:
            self.learn()
        return out

    def learn(self) -> None:
        """Encodes the words met since the last call. Words of letters only are one unit of the tokenizer each, whose last id ends a
        word; they go in joined, and the ends tell them apart. If the ends of some don't count up, these go one by one."""
        words = ["" if w in self.added else w.decode() for w in self.new]
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        groups = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False)]
        parts: list = [None] * len(words)
        for group, ids in zip(groups, found, strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                for i, start, end in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    parts[i] = ids[start:end]
        for i, w in enumerate(self.new):
            if w in self.added:
                parts[i] = np.array([self.added[w]], np.uint32)
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        self.ids = np.concatenate([self.ids, *parts])
        self.new = []

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; length of each)."""
        if len(self) > CACHE:
            self.reset()
        words, counts = split_words([self.mark_added(t) if any(n in t for n in self.names) else t for t in texts])
        coded = words.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        size = (self.starts[1:] - self.starts[:-1])[place] if len(place) else np.zeros(0, np.int64)
        flat = np.arange(int(size.sum())) + np.repeat(self.starts[place] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(place) else np.zeros(0, np.int64)
        ends = np.cumsum(np.concatenate([[0], size]))[np.cumsum(counts)] if len(texts) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([[0], ends])) + 1
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths) - 1] = False
        out[inside] = self.ids[flat]
        return out, lengths


_words: dict[str, _Words] = {}


def _together(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.Table]:
    """doc_id and text as bytes of several batches at a time, up to some MB: the more words, the more of them repeat."""
    held, size = [], 0
    for b in batches:
        held.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text").cast(pa.large_binary())], ["doc_id", "text"]))
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Ranges:
    """Ranges of documents in ascending order of (doc_id, tie), null ids first. cuts: the least (valid, doc_id, tie) of all but the first."""

    def __init__(self, cuts: list[tuple[bool, int, int]]):
        cuts = sorted(set(cuts))
        self.count = len(cuts) + 1
        self.ids = np.unique(np.array([i for valid, i, _ in cuts if valid], np.int64))
        place = np.searchsorted(self.ids, [i if valid else 0 for valid, i, _ in cuts])
        self.keys = np.array([(2 * (k + 1) + 1 if valid else 1) << 32 | tie for (valid, _, tie), k in zip(cuts, place.tolist(), strict=True)], np.int64)

    def of(self, doc_ids: np.ndarray, valid: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The range of each document. An id among the cuts is 2k + 1 of its place k, one between two of them even, null ids are 1."""
        place = np.searchsorted(self.ids, doc_ids)
        known = place < len(self.ids)
        known[known] = self.ids[place[known]] == doc_ids[known]
        rank = np.where(valid, 2 * (place + 1) + known, 1)
        return np.searchsorted(self.keys, rank.astype(np.int64) << 32 | ties, "right").astype(np.int32)


def id_ranges(rows: DataFrame, range_docs: int, range_bytes: int) -> Ranges:
    """Ranges that should hold range_docs documents or range_bytes of text, whichever is less. rows: doc_id and text.

    Up to QUANTILES quantiles of the ids, approximate ones, are divided evenly; an id that takes up several quantiles, and null ids, are
    divided by tie, a checksum. The cuts decide the size of files only, and are some bytes for each file.
    """
    size = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("valid"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    wanted = max(size["n"] // range_docs, size["bytes"] // range_bytes, 1)

    def divided(i: int | None, parts: int) -> list[tuple[bool, int, int]]:
        return [(i is not None, i or 0, (k << 32) // parts) for k in range(parts)]

    cuts = divided(None, max(1, wanted * (size["n"] - size["valid"]) // max(size["n"], 1)))[1:]
    if wanted > 1 and size["valid"]:
        n = min(wanted, QUANTILES)
        each = wanted / n
        found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(n + 1)], 10 * n).alias("q")).first()["q"]
        for low, high in zip(found[:-1], found[1:], strict=True):
            parts = max(1, min(round(each), high - low))
            cuts += [(True, low + (high - low) * k // parts, 0) for k in range(parts)] if high > low else divided(low, 1)
        for i in {i for i in found if found.count(i) > 2} if len(set(found)) < len(found) else ():
            cuts += divided(i, round((found.count(i) - 1) * each))
        cuts.append((True, found[0], 0))
    return Ranges(cuts)


def token_rows(docs: DataFrame, path: str, end_id: int, ranges: Ranges) -> DataFrame:
    """bucket, doc_id, tie and payload (compressed little-endian ids with the end id) of every whole text."""
    import_path = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        if import_path not in _words:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _words[import_path] = _Words(import_path)
        words, squeeze = _words[import_path], zstandard.ZstdCompressor(level=1)
        for b in _together(batches):
            ids, lengths = words.encode([t or b"" for t in b.column("text").to_pylist()], end_id)
            ends = np.cumsum(lengths)
            narrow = ids.astype("<u2") if int(ids.max(initial=0)) < 1 << 16 else ids
            payloads = [squeeze.compress((b"\2" if narrow.itemsize == 2 else b"\4") + narrow[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
            ties = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
            own = b.column("doc_id").combine_chunks()
            bucket = ranges.of(own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), np.array(ties, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), own, pa.array(ties, pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "doc_id", "tie", "payload"])

    return docs.mapInArrow(lean(run), "bucket int, doc_id long, tie long, payload binary")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, doc_id and tie: files of at most FILE_TOKENS tokens (or one document); a row for each file."""
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        expand = zstandard.ZstdDecompressor()
        part: dict = {"bucket": None, "docs": [], "ids": [], "tokens": 0, "number": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if part["docs"]:
                lengths = np.array([len(x) for x in part["ids"]], np.int64)
                content = write_file(np.array([d or 0 for d in part["docs"]], np.int64), np.array([d is not None for d in part["docs"]]), lengths, np.concatenate(part["ids"]))
                name = f"{part['bucket']:08d}-{part['number']:06d}-{uuid.uuid4().hex}.tok"  # an attempt that is lost leaves a file that no row names
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([part["bucket"]], pa.int32()), "number": pa.array([part["number"]], pa.int32()), "name": [name], "docs": pa.array([len(lengths)], pa.int64()), "tokens": pa.array([int(lengths.sum())], pa.int64())})
            part.update(docs=[], ids=[], tokens=0)

        for b in batches:
            for bucket, doc_id, payload in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("payload"), strict=True):
                if bucket != part["bucket"]:
                    yield from flush()
                    part.update(bucket=bucket, number=0)
                elif part["tokens"] >= FILE_TOKENS:
                    yield from flush()
                    part["number"] += 1
                raw = expand.decompress(payload.as_buffer().to_pybytes())
                ids = np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)
                part["docs"].append(doc_id)
                part["ids"].append(ids)
                part["tokens"] += len(ids)
        yield from flush()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            doc_ids, valid, lengths, ids = read_file(content.as_buffer().to_pybytes())
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths.astype(np.int64)
            whole = ids.astype("<u4")
            crcs = [zlib.crc32(whole[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(ends), pa.string()), pa.array(doc_ids, mask=~valid), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["name", "doc_id", "within", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, range_docs: int = RANGE_DOCS, range_bytes: int = RANGE_BYTES) -> tuple[str, DataFrame]:
    """Writes all texts' ids as files in ascending doc_id order; returns their folder and the manifest, a row for each file that counts.

    Texts are encoded where they are read; only compressed ids are shuffled, once, each range of doc_id to a task of its own, and sorted
    within tasks. Documents of one doc_id are ordered by a checksum of their ids, which also divides a frequent doc_id into ranges.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = id_ranges(rows, range_docs, range_bytes)
    folder = fresh_path(spark, "token-files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    coded = token_rows(rows, path, end_id, ranges)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    written = coded.repartitionById(ranges.count, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie").mapInArrow(lean(_writer(uri)), "bucket int, number int, name string, docs long, tokens long")
    return folder, materialize(written, "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""
    ship(spark)
    # running sums of files within groups of ranges, then of the groups: no window holds more than a group's files or all groups
    grouped = manifest.withColumn("group", F.floor(F.col("bucket") / GROUP))
    sums = grouped.groupBy("group").agg(F.sum("tokens").alias("all"))
    earlier = sums.select("group", F.coalesce(F.sum("all").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    before = Window.partitionBy("group").orderBy("bucket", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(earlier, "group").select("name", (F.col("inside") + F.col("earlier")).alias("offset"))
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = files.mapInArrow(lean(_decode), "name string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "name").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; null doc_ids come first; repeated rows and doc_ids keep their rows, in the order of a
    checksum of their ids; other columns are ignored; an empty table gives no rows.
    """
    folder, manifest = write_tokens(docs, path, **options)
    if manifest.isEmpty():
        return manifest.selectExpr("cast(null as long) doc_id", "cast(null as long) start", "cast(null as long) n_tokens", "cast(null as long) ids_crc32").limit(0)
    return read_tokens(docs.sparkSession, folder, manifest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return store_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
