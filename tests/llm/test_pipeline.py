import corpus_pipeline
import __spark_entry__
from sheetwise.llm import common, mixing, piece_codec, quality_cnn, quality_rules, registry, simhash
from sheetwise.llm.common import read_table

from ..conftest import DATA


def test_stages_take_effect(spark):
    docs, columns = read_table(spark, DATA, "documents"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "near-duplicates", "mixing", "encoding"]
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality classifier":
            scores = quality_cnn.score_documents(docs, quality_cnn.fit(docs, read_table(spark, DATA, "labels")))
            assert ids == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        elif name == "quality rules":
            assert ids == {r["doc_id"] for r in quality_rules.apply_rules(docs, ["doc_id"]).where("kept").collect()}
        elif name == "near-duplicates":
            assert ids == {r["component_id"] for r in simhash.near_duplicates(docs).collect()} and out.count() == len(ids)
        elif name == "mixing":
            assert out.count() == mixing.plan_mix(docs).agg({"copies": "sum"}).first()[0]
        else:
            assert out.count() == docs.count()
            break
        assert out.columns == columns
        docs = out
    assert before is None


def test_registered():
    assert {"pipeline", *registry.QUERIES} <= set(__spark_entry__.queries())
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert piece_codec.END_ID == 2


def test_run_is_its_stages(spark):
    """run() gives what the stages give one after another, and leaves nothing but their outputs."""
    docs = read_table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    mark = common.work_mark()
    got = sorted(map(str, corpus_pipeline.run(spark, DATA).collect()))
    assert got == sorted(map(str, docs.collect())) and common.work_mark() == mark + len(corpus_pipeline.STAGES) - 1


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids and sources, clashing columns; and no rows at all."""
    good = [r[:] for r in read_table(spark, DATA, "documents").join(read_table(spark, DATA, "labels").where("quality = 1"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars").limit(12).collect()]
    rows = [*good, *good[:3], (None, good[0][1], "en", None, 1), (None, None, None, None, None), (900, "", "en", "a", 0), (901, "x" * 200_000, "en", "a", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _kept int, size int, rows int, fp int, node int, score double"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 0.5) for r in rows], columns)
    spark.createDataFrame([(r[0], 1) for r in good], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= 3 * table.count(), name
            if name != "encoding":
                assert out.columns == table.columns
