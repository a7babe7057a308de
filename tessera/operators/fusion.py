"""Fusing results of several granularity levels: rows (query_id, level, doc_id, content, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a level's score; an unknown level weighs 1.
LEVEL_WEIGHTS = {"document": 0.3, "document_component": 0.5, "basic_unit_hierarchy": 0.7, "basic_unit": 1.0, "basic_unit_component": 0.9, "enumeration": 0.8}
#: Which levels a granularity group holds.
GROUPS = {
    "group_a": ("basic_unit",),
    "group_b": ("document_component", "basic_unit_hierarchy", "basic_unit"),
    "group_c": ("basic_unit", "basic_unit_component", "enumeration"),
    "group_d": ("document_component", "basic_unit_hierarchy", "basic_unit", "basic_unit_component", "enumeration"),
    "document_only": ("document",),
    "structure_only": ("document", "document_component", "basic_unit_hierarchy"),
    "content_only": ("basic_unit", "basic_unit_component", "enumeration"),
}
#: Weight of each retrieval strategy and the kinds of question it suits.
RETRIEVERS = {
    "vector_search": (1.0, ("conceptual", "case_based")),
    "hybrid_rag": (1.2, ("normative", "explicit_article")),
    "concept_graph": (1.5, ("conceptual", "comparative")),
    "multi_modal": (1.3, ("comparative", "procedural")),
    "hierarchical": (1.1, ("procedural", "normative")),
    "semantic_search": (1.0, ("conceptual", "case_based")),
}
#: What a complex question of a kind takes in if one strategy alone suits it, and with what weight.
COMPLEMENTS = {"conceptual": ("semantic_search", 0.8), "normative": ("hierarchical", 0.9)}
KINDS = ("conceptual", "normative", "explicit_article", "comparative", "procedural", "case_based")
COMPLEX = 0.7
STRATEGIES = ("weighted_sum", "reciprocal_rank", "comb_sum", "comb_sum_true", "comb_anz", "comb_mnz")


def weight(level: Column, weights: dict[str, float] = LEVEL_WEIGHTS) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(level == name, F.lit(w)).otherwise(out)
    return out


def fuse(results: DataFrame, strategy: str, least: float = 0.0, most: int = 0) -> DataFrame:
    """One row per query and distinct content: fused score, rank, how often it occurred, and level_scores, the best score of each
    level that has it (map). comb_sum is the weighted mean, comb_sum_true the plain sum. Scores
    count with nine digits and come out with twelve, behind which a quotient of weights cannot lie on a rounding tie."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    # sums of decimals do not depend on the order of the rows; scores have six digits
    w, s, n = weight(F.col("level")).cast("decimal(3,2)"), F.col("score").cast("decimal(20,9)"), F.count("*")
    exact = lambda c: F.sum(c).cast("double")
    how = {
        "weighted_sum": exact(s * w) / exact(w),
        "comb_sum": exact(s * w) / exact(w),
        "reciprocal_rank": exact(F.round(w.cast("double") / F.col("rank"), 9).cast("decimal(18,9)")),
        "comb_sum_true": exact(s),
        "comb_anz": exact(s) / n,
        "comb_mnz": exact(s) * n,
    }[strategy]
    one = results.groupBy("query_id", "doc_id", F.md5("content").alias("content_hash")).agg(how.alias("score"), n.alias("occurrences"), F.collect_set(F.struct("level", F.col("score").alias("s"))).alias("_l")).where(F.col("score") >= least)
    best = F.array_sort(F.filter("_l", lambda x: ~F.exists("_l", lambda y: (y["level"] == x["level"]) & (y["s"] > x["s"]))))
    one = one.withColumn("level_scores", F.map_from_entries(best)).drop("_l")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "doc_id", "content_hash")
    ranked = one.withColumn("rank", F.row_number().over(order))
    return (ranked.where(F.col("rank") <= most) if most else ranked).withColumn("score", F.round("score", 12))


def routes(available: tuple[str, ...], kind: str, hard: bool) -> dict[str, float]:
    """Weights of the strategies that a question takes: those that suit its kind, else a default one."""
    if unknown := set(available) - set(RETRIEVERS):
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    taken = {name: w for name, (w, kinds) in RETRIEVERS.items() if name in available and kind in kinds}
    taken = taken or {"hybrid_rag" if "hybrid_rag" in available else "vector_search": 1.0}
    extra, w = COMPLEMENTS.get(kind, ("", 0.0))
    return taken | {extra: w} if hard and len(taken) == 1 and extra in available and extra not in taken else taken


def adaptive(queries: DataFrame, results: DataFrame, available: tuple[str, ...]) -> DataFrame:
    """Fused results of the strategies that each question's kind and complexity call for: (query_id, result_id, score, strategies, rank).

    queries(query_id, kind, complexity, articles) and results(query_id, strategy, result_id, content, score, by_concept). A
    score is weighted by its strategy and counts 1.2 times where a conceptual question met a concept, 1.3 times where a
    normative and 1.5 times where an explicit one is answered with an article it names. A result's score is the mean over its
    strategies, times 1.1 where several of them found it for a complex question. Nothing is cut off; an unknown kind takes the
    default strategy, a null complexity counts as simple. All routes are one table of at most 12 rows a strategy.
    """
    routed = [(kind, hard, name, w) for kind in ("", *KINDS) for hard in (False, True) for name, w in routes(available, kind, hard).items()]
    table = F.broadcast(queries.sparkSession.createDataFrame(routed, "route string, hard boolean, strategy string, weight double"))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("")
    asked = queries.select("query_id", kind.alias("route"), F.coalesce(F.col("complexity") > COMPLEX, F.lit(False)).alias("hard"), F.coalesce("articles", F.array().cast("array<string>")).alias("articles")).join(table, ["route", "hard"])
    named = F.coalesce(F.exists("articles", lambda a: F.contains(F.col("content"), a)), F.lit(False))
    factor = F.when((F.col("route") == "conceptual") & F.coalesce("by_concept", F.lit(False)), 1.2).when((F.col("route") == "normative") & named, 1.3).when((F.col("route") == "explicit_article") & named, 1.5).otherwise(1.0)
    found = results.select("query_id", "strategy", "result_id", "content", "score", "by_concept").join(asked, ["query_id", "strategy"])
    count = F.count_distinct("strategy")
    one = found.groupBy("query_id", "result_id", "hard").agg(F.avg(F.col("score") * F.col("weight") * factor).alias("mean"), count.alias("strategies"))
    scored = one.select("query_id", "result_id", F.round(F.col("mean") * F.when(F.col("hard") & (F.col("strategies") > 1), 1.1).otherwise(1.0), 6).alias("score"), "strategies")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "result_id")))


def contributions(results: DataFrame, fused: DataFrame) -> DataFrame:
    """(query_id, level, n, mean_score, in_fused): how many results a level gave, their mean score, and how many documents of it are in
    the fused list. results(query_id, level, doc_id, score)."""
    kept = fused.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return results.join(kept, ["query_id", "doc_id"], "left").groupBy("query_id", "level").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("decimal(20,9)")).cast("double") / F.count("*"), 6).alias("mean_score"), F.count("hit").alias("in_fused"))


def strategy_performance(results: DataFrame) -> DataFrame:
    """(strategy, n, mean, low, high) of results(result_id, score, strategies array): every strategy that contributed to a result."""
    each = results.select("score", F.explode("strategies").alias("strategy"))
    return each.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("decimal(20,9)")).cast("double") / F.count("*"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


def availability(stored_levels: DataFrame) -> DataFrame:
    """(group_name, available, missing, ready): which levels of each granularity group stored_levels(level) holds."""
    have = stored_levels.select("level").distinct().withColumn("have", F.lit(True))
    joined = group_levels(stored_levels.sparkSession).join(have, "level", "left")
    lists = [F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("level")))), "|") for c in (F.col("have").isNotNull(), F.col("have").isNull())]
    return joined.groupBy("group_name").agg(lists[0].alias("available"), lists[1].alias("missing"), (F.count("have") == F.count("*")).alias("ready"))


def group_levels(spark) -> DataFrame:
    values = ", ".join(f"('{g}', '{level}')" for g, ls in GROUPS.items() for level in ls)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(group_name, level)")


def group_report(results: DataFrame, k: int) -> DataFrame:
    """Top k rows of each query within each granularity group, and their mean by group and level."""
    joined = results.join(F.broadcast(group_levels(results.sparkSession)), "level")
    order = Window.partitionBy("group_name", "query_id").orderBy(F.round("score", 6).desc(), "level", "doc_id")
    return joined.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("group_name", "level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
