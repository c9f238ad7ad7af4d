"""What the training-data operators share: the shared work folder, words, shipping code, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space character of the word definition, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch: whole texts can be long, and a worker holds a batch at a time.
BATCH_BYTES = 3 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it, or else the session's checkpoint folder.

    Without either, a session on one machine gets a folder of its own under the warehouse; any other must name one.
    """
    sc = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.work")
    return sc.getCheckpointDir().rstrip("/")


_paths: list[tuple[str, str]] = []


def remove_work(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what operators of this application wrote for themselves since a work_mark, once it is of no more use; keep_last: but the last."""
    app = spark.sparkContext.applicationId
    some = _paths[since:-1] if keep_last else _paths[since:]
    gone = {p for a, p in some if a == app}
    for path in gone:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _paths[since:] = [x for x in _paths[since:] if x[1] not in gone]


def work_mark() -> int:
    return len(_paths)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _paths.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors. options go to the writer."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers once per application, so that they need no shared installation.

    Unless the session sets another bound, Arrow batches get BATCH_BYTES bytes.
    """
    sc, bound = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def lean(run):
    """A function for mapInArrow that gives the memory it has used back to the system at its end: workers stay alive between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def word_count(text: Column) -> Column:
    """Number of words of text as a long, 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def source_key(source: Column) -> Column:
    """A string without nulls that keeps null apart from every real source."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


#: A key is hot with more rows than this and than this share of all, so there are few; its rows are dealt over so many tasks.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 1e-4, 64


def join_unique(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table, which has one row for each key and in `rows` the number of its rows; total is the number of all rows.

    The rows of hot keys are dealt over SALTS tasks, and their row of the table is repeated for each. No more than 1 / HOT_SHARE keys can
    be hot, so their list is broadcast.
    """
    often = max(HOT_ROWS, int(HOT_SHARE * total))
    hot = F.broadcast(table.where(F.col("rows") > often).select(key, F.lit(SALTS).alias("_salts")))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, key, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_row", "_salts")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("rows") > often, F.lit(SALTS - 1)).otherwise(F.lit(0))))
    return dealt.join(table.withColumn("_salt", every).drop("rows"), [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    edges: columns a and b of one orderable type; nulls, self-loops, repeats and either direction are fine. Alternating large-star
    and small-star rounds on DataFrames; every round's edges are written to the shared folder. A hub costs rows in proportion to its
    links: its minimum is pre-aggregated, its links are dealt over several tasks, and nothing gathers them into one row. An empty input
    gives no rows.
    """
    mark = work_mark()
    raw = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialize(raw, label), None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == seen or not count:
            break
        seen = (count, total)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
        large = join_unique(both, least, "a", 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        small = join_unique(large, least, "a", 2 * count).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now = materialize(small.distinct(), label)
    remove_work(edges.sparkSession, mark, keep_last=True)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
