"""Document operators against brute force and libraries, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetwise.llm import lm_score, mixing, near_copies, piece_codec, quality_cnn, quality_rules, registry, simhash, token_counts, token_files

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _kept int, fp string, kept boolean, shard int, bucket int, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", "one", "The same words of the same text and more to come.", "The same words of the same text and more to come.", "word " * 40_000, "é漢😀▁ ́x  y\r\n\x00z", "A" * 100_000]
    made = [(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, ["a", None, "b", "a", "b", "b", "a", "a", None], strict=True))]
    made += [(None, "text without an id", "en", "a"), made[4], made[4]]
    return spark.createDataFrame([(*r, 0, 1, 1.0, 1, "x", True, 1, 1, 1) for r in made], ODD)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", ["op2_mixing", "op10_quality_rules"])
def test_against_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


OPERATORS = {
    "mixing": lambda d: mixing.plan_mix(d),
    "pieces": lambda d: piece_codec.digest_documents(d, PIECES),
    "counts": lambda d: token_counts.count_tokens(d, PIECES),
    "files": lambda d: token_files.store_and_read(d, WORDS),
    "scores": lambda d: lm_score.score_documents(d),
    "simhash": simhash.near_duplicates,
    "network": lambda d: quality_cnn.score_documents(d, quality_cnn.train([b"x"], [1], epochs=1)),
    "rules": lambda d: quality_rules.apply_rules(d, ["doc_id"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_odd_row(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows_for_an_empty_table(name, odd):
    assert OPERATORS[name](odd.where("false")).count() == 0


def test_stages_keep_their_columns(odd):
    net = quality_cnn.train([b"x"], [1], epochs=1)
    net.offset[:] = 30
    for out in (quality_cnn.keep_good(odd, net), quality_rules.keep_by_rules(odd), simhash.keep_one(odd), mixing.mix(odd)):
        assert out.columns == odd.columns
        out.collect()
    assert quality_cnn.keep_good(odd, net).count() == odd.count()


def test_pieces_are_the_library_s(spark, docs, rows, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def expected(doc_id, text):
        ids = [*library.encode(text), 2]
        return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    for table in (docs, odd):
        want = [expected(r["doc_id"], r["text"] or "") for r in table.collect()]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in piece_codec.digest_documents(table, PIECES).collect())


def test_pieces_of_random_texts():
    library, codec, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("ab the  \n\t▁éñ漢字😀́<s>##\x00\x01.,ing tion 0123  ") for _ in range(r.randint(0, 25)))
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
        ids = [r.choice([r.randint(0, 31999), r.randint(0, 300)]) for _ in range(9)]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_of_long_unbroken_texts():
    library, codec, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(2)
    for letters in ("的一是不了人我在有他", "abcdefing", "é漢a"):
        text = "".join(r.choices(letters, k=3000))
        assert codec.encode(text) == library.encode(text)


def test_word_piece_lengths_are_greedy():
    starting, continuing = token_counts.word_pieces(PIECES)
    automaton, r = token_counts.LongestMatch(starting, continuing), random.Random(2)

    def greedy(word):
        n, at, known = 0, 0, starting
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
            if end is None:
                return 0
            n, at, known = n + 1, end, continuing
        return n

    for _ in range(5000):
        word = "".join(r.choice("abtheingsé漢😀.") for _ in range(r.randint(1, 10)))
        assert automaton.count(word) == greedy(word)


def test_counts(docs, rows):
    automaton = token_counts.LongestMatch(*token_counts.word_pieces(PIECES))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, PIECES).collect()}
    for doc_id, text in rows:
        counts = [automaton.count(w) for w in WORD.findall(text)]
        assert got[doc_id] == (len(counts), counts.count(0), sum(counts) + counts.count(0))


def test_token_files_are_the_library_s(docs, odd):
    library = Tokenizer.from_file(WORDS)
    for table, ranges in ((docs, 16), (odd, 2)):
        made = []
        for r in table.collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            made.append((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(ids.tobytes()), len(ids)))
        start, want = 0, []
        for doc_id, crc, n in sorted(made):
            want.append((doc_id, start, n, crc))
            start += n
        got = token_files.store_and_read(table, WORDS, range_docs=ranges).fillna(-1, "doc_id")
        assert sorted(map(tuple, got.collect())) == want


def test_frequent_and_null_ids_are_divided_into_ranges(spark, monkeypatch):
    """Half the rows have one id, some none: no range holds much more than its share, and the order is kept across ranges and groups."""
    monkeypatch.setattr(token_files, "GROUP", 3)
    r = random.Random(8)
    made = [(r.choice([7, 7, 7, None, i]), " ".join(r.choices(["ab", "cd", "efg"], k=r.randint(0, 9))), "x", 3, 4) for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, text string, name string, bucket int, tie int")
    ranges = token_files.id_ranges(frame, 20, 1 << 30)
    held = token_files.token_rows(frame.select("doc_id", "text"), WORDS, 2, ranges).groupBy("bucket").count().collect()
    assert len(held) >= 20 and max(x["count"] for x in held) <= 80
    got = sorted(map(tuple, token_files.store_and_read(frame, WORDS, range_docs=20).fillna(-1, "doc_id").collect()), key=lambda x: x[1])
    assert [(x[0], x[3]) for x in got] != [] and [x[0] for x in got] == sorted(-1 if d is None else d for d, *_ in made)
    assert [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1]]


def test_ranges_are_ordered():
    ranges = token_files.Ranges([(False, 0, 500), (True, 10, 0), (True, 10, 700), (True, -5, 0)])
    rows = [(None, 3), (None, 500), (-9, 0), (-5, 1), (9, 9), (10, 699), (10, 700), (11, 0)]
    got = ranges.of(np.array([d or 0 for d, _ in rows]), np.array([d is not None for d, _ in rows]), np.array([t for _, t in rows]))
    assert got.tolist() == [0, 1, 1, 2, 2, 3, 4, 4] and ranges.count == 5


def test_token_files_hold_added_tokens(spark):
    """Added tokens in a text get the ids that the library gives by default."""
    library = Tokenizer.from_file(WORDS)
    texts = ["First text.<|endoftext|>Second text.", "<|startoftext|>don<|endoftext|>'t <|ENDOFTEXT|> a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|>\u0338\u0301 x", "a <|endoftext| > <endoftext|>", "plain"]
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.store_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS)
    assert sorted(map(tuple, got.collect())) == want


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(numbers), n) == numbers).all()
    content = token_files.write_file(np.array([5, 0]), np.array([True, False]), np.array([3, 2]), np.array([9, 9, 70000, 1, 9], np.uint32))
    ids, valid, lengths, tokens = token_files.read_file(content)
    assert (ids.tolist(), valid.tolist(), lengths.tolist(), tokens.tolist()) == ([5, 0], [True, False], [3, 2], [9, 9, 70000, 1, 9])


class BackoffAutomaton:
    """Plain states, arcs and failure arcs of dictionaries, walked a token at a time."""

    def __init__(self, texts):
        words, pairs = collections.Counter(), collections.Counter()
        for ws in texts:
            words.update(ws)
            pairs.update(zip(["\n", *ws[:-1]], ws, strict=True))
        self.words, self.n, self.v = words, sum(words.values()), len(words)
        discount = lambda c: (lambda one, two: one / (one + 2 * two) if one and two else 0.5)(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
        d1, d2 = discount(words), discount(pairs)
        self.empty = {w: (c - d1) / self.n for w, c in words.items()}
        self.unknown = d1 * self.v / self.n
        self.arcs, self.failure = collections.defaultdict(dict), {}
        total, kinds = collections.Counter(), collections.Counter()
        for (h, _), c in pairs.items():
            total[h] += c
            kinds[h] += 1
        for h in total:
            self.failure[h] = d2 * kinds[h] / total[h]
        for (h, w), c in pairs.items():
            self.arcs[h][w] = (c - d2) / total[h] + self.failure[h] * self.empty[w]

    def score(self, ws):
        state, out = "\n" if "\n" in self.failure else None, 0.0
        for w in ws:
            if state is not None and w not in self.arcs[state]:
                out += math.log10(self.failure[state])
                state = None
            out += math.log10(self.empty.get(w, self.unknown) if state is None else self.arcs[state][w])
            state = w if w in self.failure else None
        return out


@pytest.mark.parametrize("hot", [False, True])
def test_scores_by_a_plain_automaton(docs, rows, hot, monkeypatch):
    """Also with words that are hot: their continuations are dealt over all shards."""
    if hot:
        monkeypatch.setattr(lm_score, "HOT_COUNT", 3)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tokens = {d: [*WORD.findall(lower(t)), " "] for d, t in rows}
    model = BackoffAutomaton([ws for d, ws in tokens.items() if not held[d]])
    assert math.isclose(sum(model.empty.values()) + model.unknown, 1)
    for h in list(model.failure)[:50]:
        seen = model.arcs[h]
        assert math.isclose(sum(seen.values()) + model.failure[h] * (1 - sum(model.empty[w] for w in seen)), 1)
    for shards in (1, 5):
        for r in lm_score.score_documents(docs, shards).collect():
            ws = tokens[r["doc_id"]]
            base = sum(math.log10((model.words[w] + 1) / (model.n + model.v + 1)) for w in ws)
            assert tuple(r)[1:5] == (held[r["doc_id"]], len(ws), sum(model.words[w] > 0 for w in ws), model.n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], model.score(ws), rel_tol=1e-9)


def test_held_out_texts_score_above_the_base(spark):
    got = lm_score.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_scoring_without_training_rows(spark):
    lone = next(i for i in range(99) if lm_score.is_held_out(i))
    r = lm_score.score_documents(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 == r["score"]


def brute_components(prints):
    own = {p: p for p in prints}

    def root(p):
        while own[p] != p:
            p = own[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                own[root(a)] = root(b)
    return root


def test_simhash(spark, docs, rows):
    def fingerprint(text):
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.query(spark, DATA).collect()}
    assert {d: p for d, (p, _) in got.items()} == {d: fingerprint(t) for d, t in rows}
    root, least = brute_components([p for p, _ in got.values()]), {}
    for d, (p, _) in got.items():
        least[root(p)] = min(d, least.get(root(p), d))
    assert {d: c for d, (_, c) in got.items()} == {d: least[root(p)] for d, (p, _) in got.items()}


def near_prints(count, centers, seed=3):
    r = random.Random(seed)
    return sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in (r.getrandbits(64) for _ in range(centers)) for _ in range(count)})


@pytest.mark.parametrize("group", [16, 2048])
def test_links_join_what_all_pairs_join(group, monkeypatch):
    """Also with groups too large for a task: with a small bound they come back once under finer keys, and then fit."""
    import pyarrow as pa

    prints = np.array(near_prints(60, 2), np.uint64)
    keys, place = simhash.ring_rows(prints)
    links, found = [], (keys, prints[place])
    for bound in (group, 1 << 20):
        monkeypatch.setattr(simhash, "GROUP", bound)
        order = np.argsort(found[0], kind="stable")
        batches = [pa.RecordBatch.from_arrays([pa.array(found[0][o]), pa.array(found[1][o].view(np.int64))], ["key", "fp"]) for o in np.array_split(order, 7)]
        out = pa.Table.from_batches(list(simhash._compare(iter(batches))), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])).to_pandas()
        links += [(int(a), int(b)) for a, b in out[out.linked][["a", "b"]].to_numpy().view(np.uint64)]
        large = out[~out.linked]
        if not len(large):
            break
        finer = list(simhash.refine_rows(large.a.to_numpy(), large.b.to_numpy().view(np.uint64), 1))
        found = np.concatenate(finer), np.tile(large.b.to_numpy().view(np.uint64), len(finer))
    assert (bound == group) == (group == 2048)
    root, own = brute_components(prints.tolist()), {int(p): int(p) for p in prints}

    def top(p):
        while own[p] != p:
            p = own[p]
        return p

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        own[top(a)] = top(b)
    assert len({top(int(p)) for p in prints}) == len({root(int(p)) for p in prints})


def test_one_of_each_component_stays(spark):
    text = "the first of many words that make a text long enough to be compared " * 3
    made = spark.createDataFrame([(3, text, "a"), (1, text + " indeed", "b"), (1, text, "c"), (7, "another text altogether it shares nothing", "d")], "doc_id long, text string, source string")
    kept = [r["doc_id"] for r in simhash.keep_one(made).collect()]
    assert sorted(kept) == [1, 7]


def test_near_copies_by_shingles_are_folded(spark, docs, rows):
    """The stage leaves one of each component of five-word Jaccard 0.8 or more, as all pairs give them."""

    def shingles(text):
        words = WORD.findall(lower(text))
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)}

    sets, own = [(d, shingles(t)) for d, t in sorted(rows)], {d: d for d, _ in rows}

    def top(d):
        while own[d] != d:
            d = own[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((top(d), top(e)))
                own[high] = low
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted({top(d) for d in own})
    # fewer than all pairs by three bits of op8's digests join
    assert len({top(d) for d in own}) < simhash.query(spark, DATA).select("component_id").distinct().count()


def test_rows_are_folded_by_id_and_text(spark):
    a, b = "the first text of two that share no words at all " * 2, "quite other prose which stands alone here without company " * 2
    made = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, b), (None, "null ids fold as well"), (None, "null ids fold as well")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(made).collect()) == sorted([(1, a), (5, b), (0, "null ids fold as well")])


def test_mix_repeats_rows_as_planned(spark, docs):
    plan = {(r["doc_id"]): r["copies"] for r in mixing.plan_mix(docs).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert got == collections.Counter({d: c for d, c in plan.items() if c})


def test_repeated_rows_are_taken_as_the_sql_takes_them(spark, duck):
    """Repeated rows, rows without an id and sources of any size; sums end within half a document of the target."""
    r = random.Random(4)
    made = [(i if i % 5 else None, "w " * r.choice([r.randint(1, 60), r.randint(1, 60), r.randint(1, 900)]), s) for s, n in (("a", 30), ("b", 200), (None, 90), ("d", 3)) for i in range(1, n)]
    made += [row for row in made for _ in range(2)] + [(7, "w " * 40, "b")] * 500 + [(8, "", "b"), (9, None, "a")]
    cursor = duck.cursor()
    cursor.execute("create temp table repeated(doc_id bigint, text varchar, source varchar)")
    cursor.executemany("insert into repeated values (?, ?, ?)", made)
    theirs = cursor.execute("select doc_id, size, source_size, taken from (" + mixing.SQL.replace("FROM documents", "FROM repeated") + ")").fetchall()
    plan = mixing.plan_mix(spark.createDataFrame(made, "doc_id long, text string, source string"))
    assert sorted(map(str, theirs)) == sorted(str(tuple(x)) for x in plan.select("doc_id", "size", "source_size", "taken").collect())
    for x in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect():
        assert abs(x["taken"] - x["target"]) <= 32 and x["copies"] <= mixing.MOST


def test_documents_are_taken_as_often_as_their_inclusion_probability_says(spark):
    """Over several salts: probabilities differ between the documents of a source, and copies are whole parts plus a draw."""
    r, runs = random.Random(6), 8
    made = [(i, "w " * r.choice([3, 20, 150, 700]), "ab"[i % 2]) for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string").coalesce(1)
    seen = collections.defaultdict(list)
    for k in range(runs):
        for x in mixing.plan_mix(frame, salt=f"salt{k}").collect():
            seen[x["source"], x["size"], x["inclusion"]].append(x["copies"])
    assert len(seen) == 8 and len({p for _, _, p in seen}) >= 6
    for (_, _, p), copies in seen.items():
        mean = sum(copies) / len(copies)
        assert set(copies) <= {min(copies), min(copies) + 1} and abs(mean - p - round(mean - p)) < 0.06


def test_many_sources_are_joined_by_salt(spark, docs, monkeypatch):
    want = sorted(map(str, mixing.plan_mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 3)
    assert sorted(map(str, mixing.plan_mix(docs).collect())) == want


def test_targets(spark):
    sizes = spark.createDataFrame([("sa", "a", 10), ("sb", "b", 1000), ("n", None, 500), ("sz", "z", 0)], "_key string, source string, size long")
    got = {r["_key"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a (weight 5) stops at 30; z (weight 1) at 0; b (weight 2) and null (weight 5) share 1480, null up to 1500
    assert got["sa"] == 30 and got["sz"] == 0 and math.isclose(got["sb"], 1480 * 2 / 7) and math.isclose(got["n"], 1480 * 5 / 7)


def test_mixed_words_come_near_their_targets(spark):
    by = mixing.query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), F.max("size").alias("m"))
    for r in by.collect():
        assert r["over"] <= 0 and abs(r["t"] - r["g"]) <= max(0.05 * r["g"], r["m"] / 2)


def test_held_out_quality(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = quality_cnn.query(spark, data).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.7)).all()
    assert (scored.predicted == scored.quality).mean() > 0.93


def test_network_by_brute_force():
    """Scores by loops over chunks, places and filters; also of a text that goes through in several slabs."""
    r, net = random.Random(4), quality_cnn.Network(3)
    net.bias[:] = np.linspace(-1, 1, quality_cnn.FILTERS)
    net.offset[:] = 0.3
    texts = [b"", b"x", bytes(r.randrange(256) for _ in range(700)), b"some words " * 200]

    def score(text):
        features = []
        for at in quality_cnn.chunk_places(len(text)).tolist():
            chunk = text[at : at + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
            best = [-math.inf] * quality_cnn.FILTERS
            for start in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                for f in range(quality_cnn.FILTERS):
                    best[f] = max(best[f], sum(float(net.filters[k, chunk[start + k], f]) for k in range(quality_cnn.WIDTH)))
            features.append([max(0.0, b + float(net.bias[f])) for f, b in enumerate(best)])
        pooled = [sum(c) / len(features) for c in zip(*features, strict=True)] + [max(c) for c in zip(*features, strict=True)]
        return 1 / (1 + math.exp(-sum(p * float(w) for p, w in zip(pooled, net.top, strict=True)) - 0.3))

    assert np.allclose(net.scores(texts), [score(t) for t in texts], atol=1e-5)
    long = b"a long text of many chunks " * 60_000
    assert math.isclose(net.scores([long])[0], net.scores([long, b""])[0], rel_tol=1e-6)


def test_fit_on_odd_labels(spark, docs, odd):
    """No rows, null labels, one class, texts over the byte bound."""
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    assert quality_cnn.fit(odd, labels((None, 1), (0, None))).scores([b"x", b""]).tolist() == [0.5, 0.5]
    assert quality_cnn.fit(odd.where("false"), labels((4, 1))).scores([b"x"]).tolist() == [0.5]
    assert quality_cnn.fit(odd, labels(*[(i, 1) for i in range(9)]), most=1000).scores([b"The same words"])[0] > 0.5


def test_chunks_cover_a_text():
    for n in (0, 1, 64, 512, 513, 960, 961, 5000):
        places = quality_cnn.chunk_places(n)
        covered = {i for p in places for i in range(p, p + quality_cnn.CHUNK)}
        assert set(range(n)) <= covered and len(places) >= 1


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words + words[:10]), " ".join(["a"] * 12), " ".join(words)]
    got = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in got] == [20, 12, 0]


def test_copies_that_differ_among_themselves_are_not_all_paired():
    """300 texts of 46 shingles with one of 42 edits each: all pass size and place, but only those with the same edit are similar."""
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 48, 46, dtype=np.uint64)
    sets = []
    for i in range(300):
        at = i % 42
        sets.append(np.unique(np.r_[base[:at], base[at + 5 :], r.integers(0, 1 << 48, 5, dtype=np.uint64)]))
    short = np.stack([near_copies.short_sketch(s) for s in sets])
    columns = [np.zeros(300, np.int64), np.arange(300), np.full(300, 46, np.int32), np.zeros(300, np.int32), short[:, 0].copy(), short[:, 1].copy(), np.arange(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*near_copies.ROW, "component"])
    found = {(a, b) for x in near_copies._pairs(0, None)(iter([rows])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
    assert {(a, b) for a in range(300) for b in range(a + 1, 300) if near_copies.similar(sets[a], sets[b])} <= found
    assert len(found) < 300 * 299 // 2 // 5
