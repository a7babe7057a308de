"""What is learned from the feedback on searches: pattern counts, expansion of queries by learned terms, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a pattern's threshold would move, and what a learned concept or relation adds to a query.
STEP, HIGHEST, LOWEST = 0.05, 1.0, 0.1
CONCEPT_BOOST, RELATION_BOOST = 0.1, 0.05

#: Characters of a term that are looked up before the whole term is compared.
GRAM = 3


def pattern_counts(patterns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Counts of patterns(pattern_id, threshold) after feedback(pattern_id, success), and the thresholds that they ask for.

    The threshold itself stays. Feedback on unknown patterns or with a null outcome is ignored.
    """
    said = feedback.groupBy("pattern_id").agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    up, down = F.least(F.lit(HIGHEST), F.col("threshold") + STEP), F.greatest(F.lit(LOWEST), F.col("threshold") - STEP)
    joined = patterns.join(said, "pattern_id", "left").select("pattern_id", "threshold", count("successes"), count("failures"))
    return joined.withColumns({"after_success": F.when(F.col("successes") > 0, F.round(up, 6)), "after_failure": F.when(F.col("failures") > 0, F.round(down, 6))})


def pattern_rates(counted: DataFrame) -> DataFrame:
    """Patterns, those with more successes than failures, and the share of successes (0 without feedback)."""
    tries = F.sum(F.col("successes") + F.col("failures"))
    return counted.agg(F.count("*").alias("patterns"), F.count_if(F.col("successes") > F.col("failures")).alias("successful"), F.round(F.when(tries > 0, F.sum("successes") / tries).otherwise(0.0), 6).alias("success_rate"))


def _occurring(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, order, adds, boost) of terms(order, term, adds, boost) that the query's text contains, case ignored.

    An equal join on a term's first characters finds the candidates, so no query meets all terms.
    """
    low = F.lower("text")
    grams = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, n)))))
    asked = queries.where(F.length("text") > 0).select("query_id", low.alias("low"), F.explode(grams).alias("gram"))
    known = terms.where(F.length("term") > 0).withColumn("term", F.lower("term")).withColumn("gram", F.substring("term", 1, GRAM))
    return asked.join(known, "gram").where(F.contains("low", "term")).select("query_id", "order", "adds", "boost")


def expand(queries: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """queries(query_id, text) with the learned concepts(order, name, confidence) and the targets of relations(order, source,
    target, confidence) that occur in them appended, concepts first, each in the order learned; and the confidence gained.

    A null text is empty; an empty or null name occurs nowhere.
    """
    named = concepts.select(F.struct(F.lit(0).alias("kind"), "order").alias("order"), F.col("name").alias("term"), F.col("name").alias("adds"), (F.col("confidence") * CONCEPT_BOOST).alias("boost"))
    led = relations.select(F.struct(F.lit(1).alias("kind"), "order").alias("order"), F.col("source").alias("term"), F.col("target").alias("adds"), (F.col("confidence") * RELATION_BOOST).alias("boost"))
    found = _occurring(queries, named.unionByName(led)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("order", "adds"))).alias("found"), F.sum("boost").alias("boost"))
    added: Column = F.array_join(F.transform("found", lambda x: F.concat(F.lit(" "), x["adds"])), "")
    return queries.join(found, "query_id", "left").select("query_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce(added, F.lit(""))).alias("expanded"), F.round(F.coalesce("boost", F.lit(0.0)), 6).alias("boost"))


def recent(history: DataFrame, at: str, tie: str, k: int = 10) -> DataFrame:
    """The k newest rows."""
    return history.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(k)


def distribution(concepts: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, value, n): how many learned concepts each domain, type, ... has; one pass for all dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]))
    return concepts.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
