"""Quality measures. Rankings and judgements are relations; every measure is a grouping or a window over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.labels import count_of, hierarchy
from ..functions.text import chars
from ..sources import stored
from .intervals import touching
from .set_join import small


def overlap_relevance(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """Adds relevant: the chunk holds at least `share` of the question's distinct characters. pairs(question, content)."""
    q = chars(F.col("question"))
    return pairs.withColumn("relevant", F.size(F.array_intersect(q, chars(F.col("content")))) >= share * F.size(q))


def precision_recall(ranked: DataFrame, ks: tuple, omega_k: int = 5, by: tuple = ()) -> DataFrame:
    """(by, k, precision, recall, omega) of ranked(by, query_id, rank, relevant, n_relevant): precision divides by k, recall and omega
    skip queries without a relevant row."""
    each = ranked.select(*by, "query_id", "rank", "n_relevant", F.col("relevant").cast("int").alias("hit"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    per = each.groupBy(*by, "k", "query_id").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("hits"), F.max("n_relevant").alias("r"))
    some = F.col("r") > 0
    return per.groupBy(*by, "k").agg(
        F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"),
        F.round(F.avg(F.when(some, F.col("hits") / F.col("r"))), 6).alias("recall"),
        F.round(F.avg(F.when(some, F.least("r", F.lit(omega_k)) / omega_k)), 6).alias("omega"),
    )


def threshold_measures(ranked: DataFrame, ks: tuple, share: float = 0.7) -> DataFrame:
    """Relevant rows are those within `share` of the query's best score, if positive. ranked(query_id, rank, score)."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    judged = ranked.withColumn("best", best).withColumn("relevant", (F.col("score") >= share * F.col("best")) & (F.col("score") > 0))
    total = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("query_id"))
    return precision_recall(judged.withColumn("n_relevant", total), ks, max(ks))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def map_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (span_id, doc_id, s, e) to the chunks (doc_id, chunk_index, start, end) they belong to: an interval join in buckets of
    positions, with chunks a tenth of their length wider on either side."""
    told = chunks.select("doc_id", "chunk_index", F.col("start").alias("cs"), F.col("end").alias("ce"))
    wide = 0.1 * (F.col("ce") - F.col("cs")) + 1e-9
    joined = touching(spans, told, "doc_id", (F.col("s"), F.col("e")), (F.col("cs") - wide, F.col("ce") + wide))
    over = F.greatest(F.lit(0), F.least("e", "ce") - F.greatest("s", "cs"))
    x = iou(F.col("s"), F.col("e"), F.col("cs"), F.col("ce"))
    share = F.when(F.col("e") > F.col("s"), over / (F.col("e") - F.col("s"))).otherwise(0.0)
    small = (F.col("e") - F.col("s")) < 100
    inside = (F.col("s") >= F.col("cs")) & (F.col("e") <= F.col("ce"))
    gap = F.greatest(F.lit(0), F.greatest(F.col("cs") - F.col("e"), F.col("s") - F.col("ce")))
    near = gap <= 0.1 * (F.col("ce") - F.col("cs"))
    take = (x > 0.05) | inside | (share > 0.3) | (small & ((share > 0.05) | (x > 0.005))) | (near & ((x > 0.005) | small))
    return joined.where(take).select("span_id", "doc_id", "chunk_index", F.round(x, 6).alias("iou"), F.round(share, 6).alias("share"))


def mapping_statistics(spans: DataFrame, mapped: DataFrame) -> DataFrame:
    per = spans.select("span_id").join(mapped.groupBy("span_id").agg(F.count("*").alias("n")), "span_id", "left")
    return per.agg(F.count("*").alias("n_spans"), F.count("n").alias("n_mapped"), F.round(F.count("n") / F.count("*"), 6).alias("coverage"), F.round(F.sum("n") / F.count("n"), 6).alias("chunks_per_span"))


def compare_configurations(results: DataFrame, keys: tuple = ("chunk_size", "overlap_ratio"), measures: tuple = ("n_chunks", "mean_chars")) -> DataFrame:
    """Mean measures by each key and over all, and how many configurations: grouping sets, one pass."""
    sets = [[F.col(k)] for k in keys] + [[]]
    means = [F.round(F.avg(m), 6).alias(m if m.startswith("mean") else f"mean_{m.removeprefix('n_')}") for m in measures]
    return results.groupingSets(sets, *[F.col(k) for k in keys]).agg(*means, F.count("*").alias("n_configs"))


def best_configuration(results: DataFrame, score: Column, keys: list[str]) -> DataFrame:
    return results.select(*keys, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *keys).limit(1)


def ecu(annotations: DataFrame, ks: tuple) -> DataFrame:
    """Shares in percent of k that are essential, complementary and unnecessary among the first k rows, mean over each group's queries.
    annotations(group_name, query_id, rank, label); a place without an annotation counts as none of them."""
    each = annotations.select("group_name", "query_id", "rank", "label", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    total = F.count_distinct("query_id") * F.col("k")
    pct = lambda cond: F.round(100.0 * F.count_if(cond & (F.col("rank") <= F.col("k"))) / total, 6)
    return each.groupBy("group_name", "k").agg(pct(F.col("label") == "E").alias("e_at_k"), pct(F.col("label") == "C").alias("c_at_k"), pct(F.col("label") == "U").alias("u_at_k"), pct(F.col("label").isin("E", "C")).alias("ec_at_k"))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """(level, E, C, U): annotations of each level by label."""
    return annotations.groupBy("level").pivot("label", ["E", "C", "U"]).count().fillna(0, ["E", "C", "U"])


def without_queries(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    """annotations without those of the queries in gone(query_id)."""
    return annotations.join(gone, "query_id", "left_anti")


def against_baseline(measures: DataFrame, baseline: str) -> DataFrame:
    base = measures.where(F.col("group_name") == baseline).select("k", F.col("ec_at_k").alias("base"), F.col("u_at_k").alias("base_u"))
    return measures.join(F.broadcast(base), "k").select("group_name", "k", F.round(F.col("ec_at_k") - F.col("base"), 6).alias("ec_gain"), F.round(F.col("base_u") - F.col("u_at_k"), 6).alias("u_drop"))


def faithfulness(chunks: DataFrame, ends: str = "。！？") -> DataFrame:
    """(doc_id, faithfulness, fragmentation) of chunks(doc_id, content, end).

    A chunk is as faithful as its share of pieces between end marks that are blank or end with a mark; .8 times that if it
    starts like a heading and has no mark at its end. Fragmentation is .6 of what a mean chunk lacks of the text and .4 of the
    chunks per 500 characters, within 0 and 1.
    """
    pieces = F.split("content", f"[{ends}]")
    cut = F.size(F.filter(pieces, lambda s: F.trim(s) != ""))
    whole = F.when(F.size(pieces) > 1, 1 - cut / F.size(pieces)).otherwise(1.0)
    open_ = F.col("content").rlike("^[第條項款]") & ~F.col("content").rlike(f"[{ends}]$")
    score = whole * F.when(open_, 0.8).otherwise(1.0)
    n, total = F.count("*"), F.max("end")
    frag = 0.6 * (1 - F.sum(F.length("content")) / n / total) + 0.4 * n / (total / 500)
    mean = F.sum(F.round(score, 9).cast("decimal(18,9)")).cast("double") / n
    return chunks.groupBy("doc_id").agg(F.round(mean, 6).alias("faithfulness"), F.round(F.least(F.greatest(frag, F.lit(0.0)), F.lit(1.0)), 6).alias("fragmentation"))


# --- family C: characters without blanks and marks, per query ------------------------------------------------------------------
QUESTION_MARKS, CHUNK_MARKS = " ？！，。", " ，。；："


def _characters(text: Column, without: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, without, ""), ""), lambda c: c != ""))


def character_measures(ranked: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, omega, recall) of ranked(query_id, question, rank, content) against all chunks of pool(query_id, relevant).

    A chunk holds a share of the question's characters: half of them count for precision (over the rows that there are), .3 for
    omega (over all ranked rows) and for recall (over all relevant chunks of pool, a count per query). Without characters: 0.
    """
    q = _characters(F.col("question"), QUESTION_MARKS)
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, _characters(F.col("content"), CHUNK_MARKS))) / F.size(q)).otherwise(-1.0)
    judged = ranked.select("query_id", "rank", share.alias("share"))
    first = F.col("rank") <= k
    per = judged.groupBy("query_id").agg(
        F.round(F.count_if(first & (F.col("share") >= 0.5)) / F.count_if(first), 6).alias("precision"), F.round(F.count_if(F.col("share") >= 0.3) / F.count("*"), 6).alias("omega"), F.count_if(first & (F.col("share") >= 0.3)).alias("hits")
    )
    return per.join(pool, "query_id", "left").select("query_id", "precision", "omega", F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 6).alias("recall"))


def character_pool(questions: DataFrame, chunks: DataFrame, share: float = 0.3) -> DataFrame:
    """(query_id, relevant): chunks(content) with at least `share` of a question's characters. The stated questions meet all
    chunks in one pass; nothing but counts is shuffled."""
    q = questions.select("query_id", _characters(F.col("question"), QUESTION_MARKS).alias("q")).where(F.size("q") > 0)
    c = chunks.select(_characters(F.col("content"), CHUNK_MARKS).alias("c"))
    return c.join(small(q), F.size(F.array_intersect("q", "c")) >= share * F.size("q")).groupBy("query_id").agg(F.count("*").alias("relevant"))


def character_pool_of_windows(questions: DataFrame, docs: DataFrame, cut: tuple, share: float = 0.3) -> DataFrame:
    """character_pool() of the windows of docs(text), which are not cut out one by one: cut as in window_search."""
    from . import window_search

    q = questions.select("query_id", _characters(F.col("question"), QUESTION_MARKS).alias("q")).where(F.size("q") > 0)
    held = F.filter("q", lambda c: ~F.contains(F.lit(CHUNK_MARKS), c))
    return window_search.holding(docs, q.select("query_id", held.alias("characters"), (share * F.size("q")).alias("need")), cut).withColumnRenamed("windows", "relevant")


# --- relevance by rules ---------------------------------------------------------------------------------------------------------------
def rule_points(pairs: DataFrame) -> DataFrame:
    """pairs(query_id, query, expanded, expansion, concepts, content, score, ...) with points and relevant.

    Points: .5 times the level's weight for each subject the content is about; 4 for an article asked for; 2 for each law asked for;
    .8 for each word of the expanded question, at most 3; 1.5 for each of the first five mapped concepts (2.5 for 改作); 3 if
    it holds 改作 and a rewriting is asked about; .3 for each word of the question; 1.5 times a score over .3; .3 more for a
    question without an article that has over 1. Relevant from 3 (with an article) or 1.5, .7 of that if the expansion is over 2.
    """
    q, c = F.lower("query"), F.col("content")
    numbers = F.concat(F.regexp_extract_all("query", F.lit("第[ \t\n\r]*([0-9]+)[ \t\n\r]*條"), F.lit(1)), F.regexp_extract_all("query", F.lit("條[ \t\n\r]*([0-9]+)"), F.lit(1)), F.regexp_extract_all("query", F.lit("article[ \t\n\r]*([0-9]+)"), F.lit(1)))
    explicit = F.size(numbers) > 0
    weight = F.lit(1.0)
    for level, w in V.HIERARCHY_WEIGHTS.items():
        weight = F.when(hierarchy(c) == level, F.lit(w)).otherwise(weight)
    about = 0.5 * weight * count_of(c, V.ABOUT)
    number = F.when(F.exists(numbers, lambda n: F.contains(c, F.concat(F.lit("第"), n, F.lit("條"))) | F.contains(c, F.concat(F.lit("第 "), n, F.lit(" 條")))), 4.0).otherwise(0.0)
    law = 2.0 * F.size(F.filter(F.array(*[F.lit(x) for x in V.LAW_VARIANTS]), lambda x: F.contains("query", x) & F.contains(c, x)))
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[ \t\n\r\f]+"), lambda w: w != ""))
    expansion = F.least(0.8 * F.size(F.array_intersect(words(F.col("expanded")), words(c))), F.lit(3.0))
    mapped = F.aggregate(F.slice("concepts", 1, 5), F.lit(0.0), lambda s, x: s + F.when(~F.contains(c, x), 0.0).when(x == "改作", 2.5).otherwise(1.5))
    direct = F.when(F.contains(c, F.lit("改作")) & (F.contains(q, F.lit("改寫")) | F.contains(q, F.lit("語氣"))), 3.0).otherwise(0.0)
    own = 0.3 * F.size(F.array_intersect(words(F.col("query")), words(c)))
    near = F.when(F.col("score") > 0.3, F.col("score") * 1.5).otherwise(0.0)
    base = F.round(about + number + law + expansion + mapped + direct + own + near, 6)
    got = pairs.withColumns({"_b": base, "_e": explicit}).withColumn("points", F.round(F.col("_b") + F.when(~F.col("_e") & (F.col("_b") > 1), 0.3).otherwise(0.0), 6))
    least = F.when(F.col("_e"), 3.0).otherwise(1.5) * F.when(F.col("expansion") > 2, 0.7).otherwise(1.0)
    return got.withColumn("relevant", F.col("points") >= F.round(least, 6)).drop("_b", "_e")


def rule_measures(judged: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, n_relevant) of judged(query_id, rank, relevant): of k, and of the relevant rows returned."""
    hit, n = F.count_if(F.col("relevant") & (F.col("rank") <= k)), F.count_if("relevant")
    return judged.groupBy("query_id").agg(F.round(hit / k, 6).alias("precision"), F.round(F.when(n > 0, hit / n).otherwise(0.0), 6).alias("recall"), n.alias("n_relevant"))


# --- spans without a chunk of their own -------------------------------------------------------------------------------------------------
def nearest_chunks(spans: DataFrame, chunks: DataFrame, most: int = 2000) -> DataFrame:
    """(span_id, doc_id, chunk_index, distance): the chunk of the span's document that lies nearest, the first of equals, if it is
    less than `most` characters away. Only these meet it, in buckets of positions; a partial aggregate keeps the nearest."""
    told = chunks.select("doc_id", "chunk_index", F.col("start").alias("cs"), F.col("end").alias("ce"))
    joined = touching(spans, told, "doc_id", (F.col("s") - most, F.col("e") + most), (F.col("cs"), F.col("ce")))
    gap = F.greatest(F.lit(0), F.col("cs") - F.col("e"), F.col("s") - F.col("ce"))
    near = joined.groupBy("span_id", "doc_id").agg(F.min(F.struct(gap.alias("distance"), "chunk_index")).alias("n"))
    return near.where(F.col("n.distance") < most).select("span_id", "doc_id", "n.chunk_index", "n.distance")


def map_spans_or_nearest(spans: DataFrame, chunks: DataFrame, similar: DataFrame | None = None, far: int = 1000, most: int = 2000) -> DataFrame:
    """(span_id, doc_id, chunk_index, how): map_spans(); spans that it leaves take their nearest chunk under `far` characters away, else the
    best of similar(span_id, doc_id, chunk_index, score) over .1, else the nearest under `most`."""
    mapped = map_spans(spans, chunks).select("span_id", "doc_id", "chunk_index", F.lit("span").alias("how"))
    left = spans.join(mapped.select("span_id").distinct(), "span_id", "left_anti")
    near = nearest_chunks(left, chunks, most)
    tries = near.select("span_id", "doc_id", "chunk_index", F.when(F.col("distance") < far, 1).otherwise(3).alias("order"), F.lit("nearest").alias("how"))
    if similar is not None:
        best = similar.where("score > 0.1").join(left.select("span_id"), "span_id", "left_semi").groupBy("span_id").agg(F.max_by(F.struct("doc_id", "chunk_index"), F.struct("score", -F.col("doc_id"), -F.col("chunk_index"))).alias("b"))
        tries = tries.unionByName(best.select("span_id", "b.doc_id", "b.chunk_index", F.lit(2).alias("order"), F.lit("text").alias("how")))
    first = tries.groupBy("span_id").agg(F.min_by(F.struct("doc_id", "chunk_index", "how"), "order").alias("f"))
    return mapped.unionByName(first.select("span_id", "f.doc_id", "f.chunk_index", "f.how"))


def map_by_cumulative_ranges(spans: DataFrame, chunks: DataFrame, overlap: int, least: float = 0.5) -> DataFrame:
    """(span_id, doc_id, chunk_index, iou): chunks(doc_id, chunk_index, content) whose range, told only by the lengths before it and the
    overlap, has an IoU over `least` with the span."""
    before = F.coalesce(F.sum(F.length("content") - overlap).over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = chunks.select("doc_id", "chunk_index", before.alias("cs"), (before + F.length("content")).alias("ce"))
    x = iou(F.col("s"), F.col("e"), F.col("cs"), F.col("ce"))
    met = touching(spans, ranges, "doc_id", (F.col("s"), F.col("e")), (F.col("cs"), F.col("ce")))
    return met.withColumn("iou", F.round(x, 6)).where(x > least).select("span_id", "doc_id", "chunk_index", "iou")


def configuration_score(omega: Column, precision: Column, recall: Column) -> Column:
    """.4 omega + .3 precision + .3 recall."""
    return F.round(0.4 * omega + 0.3 * precision + 0.3 * recall, 6)


def grid_evaluation(docs: DataFrame, questions: DataFrame, sizes: tuple, ratios: tuple, ks: tuple) -> DataFrame:
    """(chunk_size, overlap_ratio, n_chunks, k, precision, recall, omega): character-overlap measures of a TF-IDF search for questions(item_id, text) over
    the fixed-size chunks of every configuration. All configurations are searched in one pass over the texts, unless more frequencies
    than window_search.TRAVEL are shared by documents."""
    from . import window_search

    grid = [(size, float(ratio)) for size in sizes for ratio in ratios]
    cuts = [window_search.fixed(*g) for g in grid]
    counts = window_search.frequencies(docs, cuts)
    found = window_search.tfidf(docs, questions, cuts, max(ks), counts)
    if found is None:
        return _grid_by_indexes(docs, questions, sizes, ratios, ks)
    found = stored(found)
    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cut") + 1)
    named = docs.join(small(found.drop("score")), "doc_id").select("cut", "query_id", "rank", F.substr("text", F.col("start") + 1, of([g[0] for g in grid])).alias("content"))
    judged = overlap_relevance(named.join(small(asked), "query_id"))
    n = judged.groupBy("cut", "query_id").agg(F.count_if("relevant").alias("n_relevant"))
    windows = counts.where("term IS NULL").select(F.posexplode(F.array(*[f"n{c}" for c in range(len(cuts))])).alias("cut", "n_chunks"))
    got = precision_recall(judged.join(n, ["cut", "query_id"]), ks, by=("cut",)).join(F.broadcast(windows), "cut")
    return got.select(of([g[0] for g in grid]).alias("chunk_size"), of([g[1] for g in grid]).alias("overlap_ratio"), "n_chunks", "k", "precision", "recall", "omega")


def _grid_by_indexes(docs: DataFrame, questions: DataFrame, sizes: tuple, ratios: tuple, ks: tuple) -> DataFrame:
    """grid_evaluation() with an index for each configuration in the shared folder."""
    from . import block_index, chunking, retrieval

    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = None
    for size in sizes:
        for ratio in ratios:
            chunks = chunking.fixed_ratio(docs, size, ratio)
            blocked = block_index.blocks(chunks, retrieval.KEYS)
            found = retrieval.stored(retrieval.tfidf(chunks, questions, max(ks), blocked))
            named = docs.join(retrieval.small(found.select("doc_id").distinct()), "doc_id", "left_semi")
            contents = chunking.fixed_ratio(named, size, ratio).select("doc_id", "chunk_index", "content")
            judged = overlap_relevance(found.join(contents, ["doc_id", "chunk_index"]).join(retrieval.small(asked), "query_id"))
            n = judged.groupBy("query_id").agg(F.count_if("relevant").alias("n_relevant"))
            got = precision_recall(judged.join(n, "query_id"), ks).crossJoin(block_index.statistics(blocked).select(F.col("n").alias("n_chunks")))
            got = got.select(F.lit(size).alias("chunk_size"), F.lit(float(ratio)).alias("overlap_ratio"), "n_chunks", "k", "precision", "recall", "omega")
            out = got if out is None else out.unionByName(got)
    return out
