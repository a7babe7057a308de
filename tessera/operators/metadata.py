"""Metadata of chunks by their content: concepts, relations, types, domains, intents, and enhancement with inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.labels import any_of, article_id, count_of, held, is_article, is_chapter_or_section


def clauses(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, clause): the content's stretches without 。，；：."""
    return chunks.select(*keys, F.posexplode(F.split("content", "[。，；：]")).alias("pos", "clause")).where(F.col("clause") != "")


def _clause(pattern: str) -> str:
    """A clause pattern that may span lines; those that begin with a group begin with the clause."""
    return ("(?s)^" if pattern.startswith("(.+)") else "(?s)") + pattern


def concepts(chunks: DataFrame, rules: tuple = V.CONCEPT_RULES) -> DataFrame:
    """(chunk_id, concept, kind, importance) of chunks(chunk_id, content): the first rule's, then the first clause's, of each name.

    A clause matches a rule once at most, so no pattern runs over a whole text; nothing is shuffled but the names.
    """
    found = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(weight).alias("importance"), F.trim(F.regexp_extract("clause", _clause(p), 1)).alias("concept")) for i, (kind, p, weight) in enumerate(rules)])
    each = clauses(chunks, "chunk_id").select("chunk_id", "pos", F.explode(found).alias("f")).where(F.col("f.concept") != "")
    first = F.min_by(F.struct("f.kind", "f.importance"), F.struct("f.rule", "pos"))
    return each.groupBy("chunk_id", F.col("f.concept").alias("concept")).agg(first.alias("v")).select("chunk_id", "concept", "v.kind", "v.importance")


def relations(chunks: DataFrame, rules: tuple = V.RELATION_RULES) -> DataFrame:
    """(chunk_id, pos, subject, relation, object): who has or must do what, clause by clause."""
    found = F.array(*[F.struct(F.lit(name).alias("relation"), F.trim(F.regexp_extract("clause", _clause(p), 1)).alias("subject"), F.trim(F.regexp_extract("clause", _clause(p), 2)).alias("object")) for p, name in rules])
    each = clauses(chunks, "chunk_id").select("chunk_id", "pos", F.explode(found).alias("f"))
    return each.where("f.subject <> '' AND f.object <> ''").select("chunk_id", "pos", "f.subject", "f.relation", "f.object")


def article_type(content: Column) -> Column:
    """struct<type, confidence>: min(.9, .2 n + .3) for n words of a type; the first type above .5 and all before it, else general."""
    start = F.struct(F.lit("一般規定").alias("type"), F.lit(0.5).alias("confidence"))
    each = F.array(*[F.struct(F.lit(name).alias("type"), F.round(F.least(F.lit(0.9), 0.2 * count_of(content, words) + 0.3), 6).alias("confidence")) for name, words in V.ARTICLE_TYPES.items()])
    return F.aggregate(each, start, lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a))


def domain(content: Column) -> Column:
    """struct<domain, confidence, related>: the first domain with most keywords, even none; confidence a fifth a keyword, at most 1."""
    each = F.array(*[F.struct(F.lit(name).alias("domain"), count_of(content, words).alias("n")) for name, words in V.LEGAL_DOMAINS.items()])
    best = F.aggregate(each, F.struct(F.lit("").alias("domain"), F.lit(-1).alias("n")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    related = F.transform(F.filter(each, lambda x: (x["n"] > 0) & (x["domain"] != best["domain"])), lambda x: x["domain"])
    return F.struct(best["domain"].alias("domain"), F.least(F.lit(1.0), best["n"] / 5).alias("confidence"), related.alias("related"))


def light_domain(content: Column) -> Column:
    """struct<domain, confidence>: the first domain with a keyword (.7), else 其他 (.1)."""
    hit = F.coalesce(*[F.when(any_of(content, words), F.lit(name)) for name, words in V.LEGAL_DOMAINS.items()])
    return F.struct(F.coalesce(hit, F.lit("其他")).alias("domain"), F.when(hit.isNotNull(), 0.7).otherwise(0.1).alias("confidence"))


def tags(content: Column, groups: dict[str, tuple]) -> Column:
    """The groups of which the content holds a word, in their order."""
    return F.filter(F.array(*[F.when(any_of(content, words), F.lit(name)) for name, words in groups.items()]), lambda x: x.isNotNull())


def chapter_type(content: Column) -> Column:
    """struct<type, confidence> of chapters and sections; the first that applies."""
    out = F.struct(F.lit("一般章節").alias("type"), F.lit(0.5).alias("confidence"))
    for pattern, name, confidence in reversed(V.CHAPTER_TYPES):
        out = F.when(content.rlike(pattern), F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def structural_concepts(content: Column) -> Column:
    """array<struct<concept, kind, importance>> of the structural words held."""
    each = [F.when(F.contains(content, F.lit(w)), F.struct(F.lit(w).alias("concept"), F.lit(kind).alias("kind"), F.lit(x).alias("importance"))) for w, kind, x in V.STRUCTURAL]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def canned_questions(content: Column, most: int = 5) -> Column:
    """Questions that the content may answer, at most five."""
    parts = [F.when(content.rlike(p), F.array(*[F.lit(q) for q in qs])).otherwise(F.array().cast("array<string>")) for p, qs in V.CANNED]
    return F.slice(F.concat(*parts), 1, most)


def keywords(content: Column) -> Column:
    """struct of the statute terms, structural words and words of scope held."""
    return F.struct(held(content, V.STATUTE_TERMS).alias("terms"), held(content, ("章", "節", "總則", "分則", "附則", "規定", "原則")).alias("structural"), held(content, ("範圍", "定義", "原則", "一般", "特殊", "例外")).alias("scope"))


def enhanced(chunks: DataFrame) -> DataFrame:
    """(chunk_id, enhancement, article_id, type, domain, domain_confidence, intents, scopes, inherited_from) of chunks(chunk_id,
    content, level, category, article_number).

    Equal contents are worked out once, by md5, from the row with the least chunk_id, and mapped back to all. Articles are
    enhanced in full, chapters and sections in medium depth. Other chunks inherit from the article they name, if one is
    there (the last of several by chunk_id), else they get the light domain only. Nulls in content are empty.
    """
    rows = chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), "level", "category", "article_number").withColumn("hash", F.md5("content"))
    one = rows.groupBy("hash").agg(F.min_by(F.struct("chunk_id", "content", "level", "category", "article_number"), "chunk_id").alias("c")).select("hash", "c.*")
    c = F.col("content")
    how = F.when(is_article(c, F.col("level")), "full").when(is_chapter_or_section(c, F.col("level")), "medium").otherwise("light")
    work = one.select("hash", "chunk_id", "content", how.alias("how"), article_id(c, F.col("category"), F.col("article_number")).alias("article_id"))
    kind = F.when(F.col("how") == "full", article_type(c)["type"]).when(F.col("how") == "medium", chapter_type(c)["type"])
    full = domain(c)
    dom = F.when(F.col("how") == "light", light_domain(c)).otherwise(F.struct(full["domain"].alias("domain"), full["confidence"].alias("confidence")))
    made = work.select("hash", "chunk_id", "how", "article_id", kind.alias("type"), dom.alias("d"), F.when(F.col("how") == "full", tags(c, V.INTENTS)).alias("intents"), F.when(F.col("how") == "medium", tags(c, V.SCOPES)).alias("scopes"))
    columns = ["type", "d", "intents", "scopes"]
    parents = made.where("how = 'full' AND article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct(*columns), "chunk_id").alias("p"))
    joined = made.join(parents, "article_id", "left").withColumn("takes", (F.col("how") == "light") & F.col("p").isNotNull())
    done = joined.select(
        "hash", F.when(F.col("takes"), "inherited").otherwise(F.col("how")).alias("enhancement"), "article_id",
        *[F.when(F.col("takes"), F.col(f"p.{x}")).otherwise(F.col(x)).alias(x) for x in columns], F.when(F.col("takes"), F.col("article_id")).alias("inherited_from"),
    )
    return rows.select("chunk_id", "hash").join(done, "hash").select("chunk_id", "enhancement", "article_id", "type", "d.domain", F.col("d.confidence").alias("domain_confidence"), "intents", "scopes", "inherited_from")


def statistics(done: DataFrame) -> DataFrame:
    """(enhancement, n, inherited, articles) of enhanced(): chunks by depth, those that inherit, and distinct articles."""
    return done.groupBy("enhancement").agg(F.count("*").alias("n"), F.count("inherited_from").alias("inherited"), F.count_distinct("article_id").alias("articles"))


def updated(metadata: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """metadata with the newest non-null values of changes(key, at, columns to set); keys that metadata lacks are not added."""
    columns = [c for c in changes.columns if c not in (key, at)]
    newest = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_{c}") for c in columns])
    joined = metadata.join(newest, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in metadata.columns])


def concept_statistics(chunks: DataFrame) -> DataFrame:
    """One row over chunks(concept_count, importance, has_definition, has_exception, has_condition): how many hold concepts,
    definitions, exceptions and conditions, the mean importance of those with concepts, and concepts per chunk."""
    some = F.col("concept_count") > 0
    n = F.count("*")
    return chunks.agg(
        n.alias("total_chunks"), F.count_if(some).alias("concept_chunks"), F.count_if("has_definition").alias("definition_chunks"), F.count_if("has_exception").alias("exception_chunks"), F.count_if("has_condition").alias("condition_chunks"),
        F.round(F.coalesce(F.sum(F.when(some, F.col("importance"))) / F.count_if(some), F.lit(0.0)), 6).alias("avg_importance"),
        F.round(F.when(n > 0, F.sum(F.when(some, F.col("concept_count")).otherwise(0)) / n).otherwise(0.0), 6).alias("concept_density"),
    )
