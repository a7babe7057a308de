"""From raw documents to shards: five stages, each of them one operator of tessera.llm, with Parquet between them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from tessera.llm.common import comparable, row_names, shared_folder, shielded, stored, table

#: A document stays if at least this share of its words is in one language.
LEAST_SCORE = 0.4
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a main language, go. Learns from documents outside the held-out quarter. Rows are
    judged one by one, long texts whole; null and empty texts have no letter. All columns stay."""
    model = language_id.fit(docs.where(~F.coalesce(language_id.held_out(4, 2), F.lit(False))))
    judged = language_id.identify(shielded(docs, "text"), model)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the least doc_id, null last. All columns stay."""
    return simhash_dedup.one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that is mostly such passages goes. n_chars follows the text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whatever its doc_id; one that it takes no copy of goes.

    Rows equal in all columns stand for one another: one of them takes the copies of all.
    """
    rows = shielded(docs, "text", "source")
    named = rows.withColumns(row_names(rows))
    copies = mixing.copies(named.withColumn("_row", F.struct("_a", "_b")), "_row").groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_n"))
    taken = stored(copies.where("_copies > 0").select("_row._a", "_row._b", "_copies", "_n"))
    out = named.join(taken.where("_n = 1"), ["_a", "_b"])
    equal = taken.where("_n > 1")
    if not equal.isEmpty():
        out = out.unionByName(named.join(equal, ["_a", "_b"]).dropDuplicates(["_a", "_b"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*rows.columns).toDF(*docs.columns)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, with shard and slot. Keys are permuted without their texts and meet them at the end.

    Rows equal in doc_id and text share their places, and the k-th of them takes the k-th place; after the mix these are the
    copies of one document. Columns of docs named shard or slot, in any case, are replaced. doc_id is an integer.
    """
    given = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = shielded(docs.select(*given), "doc_id", "text")
    keys = {"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_crc": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))}
    keyed = rows.withColumns(keys)
    dealt = sharding.shard(stored(keyed.select("_id", "_crc")), ["_id", "_crc"]).groupBy("_id", "_crc").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("_places"))
    numbered = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_crc").orderBy(*comparable(rows.drop("text")))))
    return numbered.join(dealt, ["_id", "_crc"]).withColumn("_place", F.element_at("_places", F.col("_k"))).select(*rows.columns, "_place.shard", "_place.slot").toDF(*given, "shard", "slot")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources", mix_sources),
    ("sharding", shuffle_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
