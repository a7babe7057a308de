"""Reading, writing and keeping tables: Parquet tables, plain text, JSON statutes, level-partitioned stores, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over all cores if its files make fewer partitions than there are cores: one row group would keep one core busy.
    Only small inputs are shuffled so; those with work for every core stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session on one machine that has none gets a new temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def stored(df: DataFrame, group: int | None = None) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back; lost executors cost only the tasks they ran.

    group: bytes of a row group. Readers hold up to 4,096 rows of one row group at once, so tables of large rows need small groups.
    """
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    written = df.write.option("compression", "zstd")
    if group is not None:  # by default the writer first looks at a group's size after 100 rows
        written = written.option("parquet.block.size", group).option("parquet.page.size.row.check.min", 4)
    written.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: (filename, text), trimmed; empty ones are left out."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.trim("value").alias("text")).where(F.length("text") > 0)


#: A statute as JSON: laws, chapters, sections, articles, and up to three levels of parts below, under older or newer names.
_PART = "content: string, metadata: struct<id: string, category: string, article_label: string, page: string>"
STATUTE = (
    "laws array<struct<law_name: string, chapters: array<struct<chapter: string, sections: array<struct<section: string, articles: array<struct<article: string, " + _PART + ", "
    "paragraphs: array<struct<paragraph: string, " + _PART + ", subparagraphs: array<struct<subparagraph: string, " + _PART + ", items: array<struct<item: string, " + _PART + ">>>>>>, "
    "items: array<struct<item: string, " + _PART + ", sub_items: array<struct<sub_item: string, " + _PART + ", items: array<struct<item: string, " + _PART + ">>>>>>>>>>>>>>"
)


def json_documents(spark: SparkSession, path: str, schema: str = STATUTE) -> DataFrame:
    """One row per JSON file: (filename, columns of the schema)."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_statutes(documents: DataFrame, column: str = "json", schema: str = STATUTE) -> DataFrame:
    """documents with their JSON column parsed as statutes, as `laws`; what is no JSON gives null."""
    return documents.withColumn("laws", F.from_json(column, schema)["laws"])


def write_levels(chunks: DataFrame, path: str) -> None:
    """Writes a chunk table by level, replacing only the levels that chunks holds."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(path)


def read_levels(spark: SparkSession, path: str, levels: tuple = ()) -> DataFrame:
    """The chunk table of write_levels(), of the given levels only (partitions that are not asked for are not read)."""
    chunks = spark.read.parquet(path)
    return chunks.where(F.col("level").isin(*levels)) if levels else chunks


def replace_documents(store: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """store with the rows of the documents in new replaced by theirs: derived rows of a replaced document go with it."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*store.columns))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
