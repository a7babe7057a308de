"""Searches made of several: by levels of a hierarchy, routed by the question, fused over levels; contexts for answers; inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from . import enrichment, fusion, retrieval

#: Levels in the order they are tried if the one asked for is missing.
FALLBACK = ("basic_unit", "basic_unit_component", "enumeration", "basic_unit_hierarchy", "document_component", "document")
#: Weight of a result by the level of its content, levels in the order they are taken.
TAKEN = (("article", 1.0), ("section", 0.8), ("chapter", 0.6))


def by_hierarchy(ranked: DataFrame, levels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, hierarchy, score, rank) of ranked(query_id, chunk_id, score, rank), whose rank counts all chunks, and
    levels(chunk_id, hierarchy): articles among the first 2 k, then sections and chapters among the first k, weighted, until there are k.

    A level's pool is no longer than the level has chunks. Results go by level, then by rank; there is no sort by score.
    """
    sizes = F.broadcast(levels.groupBy("hierarchy").agg(F.count("*").alias("size")))
    table = ", ".join(f"('{name}', {i}, {w}D, {k * 2 if not i else k})" for i, (name, w) in enumerate(TAKEN))
    taken = F.broadcast(ranked.sparkSession.sql(f"SELECT * FROM VALUES {table} AS t(hierarchy, level, weight, pool)"))
    rows = ranked.where(F.col("rank") <= 2 * k).join(levels, "chunk_id").join(sizes, "hierarchy").join(taken, "hierarchy").where(F.col("rank") <= F.least("pool", "size"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("level", "rank"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("query_id", "chunk_id", "hierarchy", F.round(F.col("score") * F.col("weight"), 6).alias("score"), F.col("place").alias("rank"))


def routed(questions: DataFrame, results: DataFrame, groups: tuple = (), k: int = 10) -> DataFrame:
    """(query_id, level, doc_id, score, rank): the first k results of the level that questions(query_id, recommended) ask for, or of the next one in
    FALLBACK that results(query_id, level, doc_id, score, rank) have at all; groups restrict the levels to those of granularity groups."""
    have = results.select("level").distinct()
    if groups:
        have = have.join(fusion.group_levels(results.sparkSession).where(F.col("group_name").isin(*groups)).select("level").distinct(), "level", "left_semi")
    order = F.array(*[F.lit(x) for x in FALLBACK])
    choices = F.broadcast(have.where(F.col("level").isin(*FALLBACK)).withColumn("place", F.array_position(order, F.col("level"))))
    chosen = questions.join(choices).groupBy("query_id").agg(F.min_by("level", F.when(F.col("level") == F.col("recommended"), 0).otherwise(F.col("place"))).alias("level"))
    return results.join(chosen, ["query_id", "level"]).where(F.col("rank") <= k).select("query_id", "level", "doc_id", "score", "rank")


def enhanced_levels(candidates: DataFrame, k: int = 10, strategy: str = "weighted_sum") -> DataFrame:
    """Fused rows of fuse() over the enhanced hybrid scores of each level's first k candidates (query_id, level, doc_id, content, vec,
    bm25, bonus, title)."""
    scored = candidates.withColumn("score", F.round(retrieval.enhanced_score(), 6))
    first = retrieval.top(scored, ["query_id", "level"], k, ["doc_id"])
    return fusion.fuse(first.select("query_id", "level", "doc_id", "content", "score", "rank"), strategy, -1.0, k)


def with_contents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(chunk_id, ...) joined with chunks(chunk_id, content). Only chunks that ranked names are shuffled, not all texts."""
    ranked = stored(ranked)
    return ranked.join(chunks.join(retrieval.small(ranked.select("chunk_id").distinct()), "chunk_id", "left_semi"), "chunk_id")


def contexts(ranked: DataFrame, chunks: DataFrame, k: int = 5, most: int = 2000) -> DataFrame:
    """(query_id, context, n_chunks): the first `most` characters of the first k chunks of each question, in order, a blank line between.
    chunks(chunk_id, content)."""
    rows = with_contents(ranked.where(F.col("rank") <= k), chunks).select("query_id", F.struct("rank", "chunk_id", F.substring("content", 1, most).alias("said")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["said"]), "\n\n").alias("context"), F.count("*").alias("n_chunks"))


def answers(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """extractive_answers() from the first k chunks of each question; ranked(query_id, chunk_id, rank), questions(query_id, question)."""
    found = with_contents(ranked.where(F.col("rank") <= k), chunks).join(retrieval.small(questions), "query_id")
    return enrichment.extractive_answers(found.select("query_id", "question", "rank", "content"))


def with_documents(results: DataFrame, documents: DataFrame) -> DataFrame:
    """results with the name of their document, documents(doc_id, name); Unknown where there is none."""
    return results.join(documents.select("doc_id", "name"), "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def inventory(vectors: DataFrame) -> DataFrame:
    """(level, n_vectors, n_documents, dimension, n_missing) of vectors(doc_id, level, embedding); null vectors are missing."""
    return vectors.groupBy("level").agg(F.count("embedding").alias("n_vectors"), F.count_distinct("doc_id").alias("n_documents"), F.max(F.size("embedding")).alias("dimension"), F.count_if(F.col("embedding").isNull()).alias("n_missing"))


def inferred_group(vectors: DataFrame) -> DataFrame:
    """(group_name): the granularity groups that hold just the levels of vectors, by name; no row if there is none."""
    spark = vectors.sparkSession
    have = vectors.select("level").distinct()
    groups = fusion.group_levels(spark)
    both = groups.join(have.withColumn("have", F.lit(1)), "level", "left").groupBy("group_name").agg(F.count("*").alias("n"), F.count("have").alias("hits"))
    return both.join(F.broadcast(have.agg(F.count("*").alias("levels")))).where("n = hits AND n = levels").select("group_name")


def without(store: DataFrame, levels: tuple) -> DataFrame:
    """store without some levels: what deactivating an embedding table leaves."""
    return store.where(~F.col("level").isin(*levels))
