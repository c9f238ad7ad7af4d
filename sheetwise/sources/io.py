"""Sources and sinks of documents, pages and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_SCHEMA = "page int, x0 double, y0 double, x1 double, y1 double, text string, origin string, fontname string, font_size double, confidence double"


def register_documents(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """doc_id (sha256 of the bytes), path and length of the files with a %PDF head that `known` doesn't hold; empty files are left out."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    pdf = files.where(F.substring("content", 1, 4) == F.encode(F.lit("%PDF"), "utf-8"))
    docs = pdf.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("doc_id"), "path", "length")
    return docs if known is None else docs.join(known.select("doc_id"), "doc_id", "left_anti")


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file of a run; unknown keys are dropped, missing ones null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from JSON lines: example_id, label, features (any numbers by name) and split."""
    return spark.read.schema("example_id string, label string, features map<string,double>, split string").json(path)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def graphics(lines: DataFrame, rects: DataFrame, curves: DataFrame) -> DataFrame:
    """page, element_type and box: lines with ordered ends, rects as they are, curves by the box of their points; empty curves go."""
    ends = [F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1")]
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    curved = curves.where("pts is not null and size(pts) > 0").select("page", F.lit("curve").alias("element_type"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    straight = lines.select("page", F.lit("line").alias("element_type"), *ends)
    return straight.unionByName(rects.select("page", F.lit("rect").alias("element_type"), "x0", "y0", "x1", "y1")).unionByName(curved)


def coco(images: DataFrame, boxes: DataFrame, categories: list[str]) -> DataFrame:
    """Annotations as JSON, one per box of a known label; ids count by image name and box."""
    from pyspark.sql import Window

    named = F.array(*[F.lit(c) for c in categories])
    known = boxes.join(images.select("image_id", "name"), "name").withColumn("category_id", F.array_position(named, F.col("label"))).where("category_id > 0")
    row = F.struct(F.row_number().over(Window.partitionBy("image_id").orderBy("x0", "y0")).alias("id"), "image_id", "category_id", F.array(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bbox"))
    return known.select("image_id", F.to_json(row).alias("annotation"))
