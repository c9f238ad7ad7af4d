"""SentencePiece merge-type encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, read_table, ship

END_ID = 2
BAR = "▁"
LATIN = "A-Za-zÀ-ɏ"
#: Units kept per worker; the cache is emptied when full.
CACHE = 150_000
#: Characters from which on a unit is encoded in linear time, a little slower for short ones.
LONG = 128


class PieceCodec:
    """Encodes like a merge-type SentencePiece model with an identity normalizer, a dummy prefix and byte fallback; decodes likewise.

    Encoding takes the longest piece at each position from an Aho-Corasick automaton and keeps it if it may follow the piece before:
    two pieces may stand together if merging their joined text again gives just these two. Otherwise it tries the next shorter piece
    that is a prefix, or goes back a piece and marks the position as failed in a bitfield, so that each is left at most once.
    """

    def __init__(self, path: str):
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.model_type != 2 or not train.byte_fallback:
            raise ValueError("the model must be of the merge type with byte fallback, an identity normalizer and a dummy prefix")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, k in enumerate(kinds) if k == 3}
        self.unknown = {i for i, k in enumerate(kinds) if k == 2}
        inside = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(x[1] == BAR != x[0] or "\n" in x for x in inside):
            raise ValueError("no piece may hold a space after another character, or a line break beside one")
        # No piece goes over the ends of these units; finer ones repeat more often.
        letter = re.compile(f"[{LATIN}]").match
        mixed = any(BAR not in x and bool(letter(x[0])) != bool(letter(x[1])) for x in inside)
        self.units = re.compile(f"{BAR}+[^{BAR}\n]*|[^{BAR}\n]+|\n" if mixed else f"{BAR}*[{LATIN}]+|{BAR}*[^{LATIN}{BAR}\n]+|{BAR}+|\n").findall
        self.fits_memo: dict[tuple[str, str], bool] = {}
        # only pieces that merging their own text gives can be in a result
        reachable = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]
        self.longest = ahocorasick.Automaton()
        for p in reachable:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.most = max(map(len, reachable)) + 1
        known = set(reachable)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in reachable}
        self.characters = {p for p in reachable if len(p) == 1}

    def merge(self, text: str) -> list[str]:
        """The pieces by repeated merging: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        if (known := self.fits_memo.get(key)) is None:
            if len(self.fits_memo) > CACHE:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all pieces."""
        if len(text) > LONG:
            return self.backtrack_long(text)
        end, failed, parts, at, match, known = len(text), 0, [], 0, self.longest.iter_long, self.fits_memo.get
        piece = next(match(text))[1]
        while True:
            following = at + len(piece)
            if not failed >> following & 1 and (not parts or (known((parts[-1], piece)) or self.fits(parts[-1], piece))):
                parts.append(piece)
                at = following
                if at == end:
                    return parts
                piece = next(match(text, at))[1]
            elif (shorter := self.shorter[piece]) is not None:
                piece = shorter
            else:
                failed |= 1 << at
                piece = parts.pop()
                at -= len(piece)

    def backtrack_long(self, text: str) -> list[str]:
        """The same in time and memory linear in the text: the bits are bytes, and the automaton, which reads on to the end of what it is
        given, gets no more than the longest of all pieces."""
        end, failed, parts, at, match, most = len(text), bytearray((len(text) >> 3) + 1), [], 0, self.longest.iter_long, self.most
        piece = next(match(text[:most]))[1]
        while True:
            following = at + len(piece)
            if not failed[following >> 3] >> (following & 7) & 1 and (not parts or self.fits(parts[-1], piece)):
                parts.append(piece)
                at = following
                if at == end:
                    return parts
                piece = next(match(text[at : at + most]))[1]
            elif (shorter := self.shorter[piece]) is not None:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = parts.pop()
                at -= len(piece)

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a text in which a space is a bar already; characters without a piece become their bytes."""
        ids: list[int] = []
        start = 0
        for i, c in enumerate(unit):
            if c not in self.characters:
                if i > start:
                    ids += [self.ids[p] for p in self.backtrack(unit[start:i])]
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        if start < len(unit):
            ids += [self.ids[p] for p in self.backtrack(unit[start:])]
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without an end id; none for an empty text."""
        return [i for u in self.split(text) for i in self.encode_unit(u)]

    def split(self, text: str) -> list[str]:
        return self.units(BAR + text.replace(" ", BAR)) if text else []

    def decode_pieces(self, ids: list[int]) -> str:
        """The text of ids, with the dummy prefix still there."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i in self.unknown else self.pieces[i].replace(BAR, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space of a first piece goes if that is no byte."""
        first = next((i for i in ids if i not in self.silent), END_ID)
        text = self.decode_pieces(ids)
        return text[1:] if first not in self.unknown and first not in self.byte_of and text[:1] == " " else text


def _utf8(run: bytearray) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    out, i = [], 0
    while i < len(run):
        n = next((n for n in (1, 2, 3, 4) if _whole(run[i : i + n])), 0)
        out.append(run[i : i + n].decode() if n else "�")
        i += n or 1
    return "".join(out)


def _whole(part: bytearray) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


class _Units(dict):
    """unit: (its ids as text, its decoded text)."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> tuple[str, str]:
        codec = self.codec
        if codec.characters.issuperset(unit):
            parts = codec.backtrack(unit)
            value = " ".join([codec.id_text[p] for p in parts]), "".join(parts).replace(BAR, " ")
        else:
            ids = codec.encode_unit(unit)
            value = " ".join(map(str, ids)), codec.decode_pieces(ids)
        if len(self) >= CACHE:
            self.clear()
        if len(unit) <= 64:
            self[unit] = value
        return value


_codecs: dict[str, tuple[PieceCodec, _Units]] = {}


def codec_of(path: str) -> tuple[PieceCodec, _Units]:
    """One codec and cache per worker and model."""
    if path not in _codecs:
        codec = PieceCodec(path)
        _codecs[path] = codec, _Units(codec)
    return _codecs[path]


def encode_text(codec: PieceCodec, units: _Units, text: str, end_id: int | None = END_ID) -> tuple[str, str]:
    """(ids as decimal numbers joined by a space, the text decoded from them)."""
    found = list(map(units.__getitem__, codec.split(text)))
    tail = [] if end_id is None else [str(end_id)]
    return " ".join([x[0] for x in found] + tail), "".join([x[1] for x in found]).removeprefix(" ")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, by encoding every whole text and decoding its ids again.

    No shuffle: each Arrow batch is encoded where it was read, with a bounded cache of units per worker. Null texts count as empty (one
    id, the end); repeated rows and null doc_ids each keep their row; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, units = codec_of(path)
        for b in batches:
            n, a, d = [], [], []
            for text in b.column("text"):
                ids, decoded = encode_text(codec, units, text.as_py() or "")
                n.append(ids.count(" ") + 1)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
