"""Token counts: greedy word-piece lengths from a longest-match automaton, without building pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, read_table, ship

#: Words kept per worker; the cache is emptied when full.
CACHE = 400_000


class LongestMatch:
    """A trie over a word-piece vocabulary with two roots (pieces that start a word, pieces that go on), failure links, and for each
    link the number of pieces that it pops. A word is read once from left to right, in time linear in its length.

    A word's count is that of greedy longest-match-first: the longest starting piece, then the longest continuing piece again and again.
    A word that greedy matching can't finish is one unknown token.
    """

    def __init__(self, starting: set[str], continuing: set[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]

        def add(root: int, piece: str) -> None:
            node = root
            for c in piece:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                node = self.step[node][c]
            ends[node] = True

        for piece in sorted(starting - {""}):
            add(0, piece)
        for piece in sorted(continuing - {""}):
            add(1, piece)
        self.fail: list[int] = [-1] * len(self.step)
        self.pops = [0] * len(self.step)
        queue = [0, 1]
        for node in queue:  # breadth-first: a link leads to a shallower node, or to the second root
            for c, child in self.step[node].items():
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    link, pops = self.fail[node], self.pops[node]
                    while link >= 0 and c not in self.step[link]:
                        pops += self.pops[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[child], self.pops[child] = self.step[link][c], pops
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be matched."""
        node, n, step, fail, pops = 0, 0, self.step, self.fail, self.pops
        for c in word:
            while c not in step[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = step[node][c]
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def word_pieces(path: str) -> tuple[set[str], set[str]]:
    """(starting, continuing) pieces of a SentencePiece model: with and without the bar."""
    import sentencepiece.sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal = [p.piece for p in model.pieces if p.type == 1]
    return {p[1:] for p in normal if p[0] == "▁" and "▁" not in p[1:]} - {""}, {p for p in normal if "▁" not in p}


class _Counts(dict):
    """UTF-8 word: its pieces, 0 if unknown."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.automaton.count(word.decode())
        if len(word) <= 64:
            self[word] = n
        return n


_counts: dict[str, _Counts] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_unknown, n_tokens (an unknown word is one token).

    Words are runs without ASCII white space, of whole texts; a null or empty text has none. No shuffle; a bounded cache per worker.
    Repeated rows and null doc_ids keep their rows; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = _Counts(LongestMatch(*word_pieces(path)))
        known = _counts[path]
        for b in batches:
            words, unknown, tokens = [], [], []
            for text in b.column("text").cast(pa.large_binary()):
                counts = list(map(known.__getitem__, text.as_buffer().to_pybytes().split() if text.is_valid else ()))
                words.append(len(counts))
                unknown.append(counts.count(0))
                tokens.append(sum(counts) + unknown[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, unknown, tokens))], ["doc_id", "n_words", "n_unknown", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, n_unknown long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
