"""What a question asks for: granularity, kind, complexity, features, and the legal concepts that reasoning adds. Word tables are
literals inside the row, so nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.labels import any_of, held


def _times(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def granularity_asked(text: Column, levels: dict[str, tuple] = V.LEVEL_PATTERNS) -> Column:
    """struct<level, confidence, recommended>: .1 a match and .01 a matched character of each pattern, at most 1 a level; the
    first of equal levels. Under .3 with over .5 in all it is mixed, and the basic unit is recommended."""
    low = F.lower(F.trim(text))

    def score(patterns: tuple) -> Column:
        found = [F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in patterns]
        return F.least(F.lit(1.0), sum((0.1 * F.size(m) + 0.01 * F.length(F.array_join(m, "")) for m in found), F.lit(0.0)))

    scores = F.array(*[F.struct(F.round(score(ps), 9).alias("score"), F.lit(name).alias("level")) for name, ps in levels.items()])
    best = F.aggregate(scores, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("level")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    total = F.round(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["score"]), 9)
    mixed = (best["score"] < 0.3) & (total > 0.5)
    confidence = F.when(mixed, 0.5).when(total > 0, F.round(best["score"] / total, 6)).otherwise(0.0)
    return F.struct(F.when(mixed, "mixed").otherwise(best["level"]).alias("level"), confidence.alias("confidence"), F.when(mixed, "basic_unit").otherwise(best["level"]).alias("recommended"))


def kind(text: Column) -> Column:
    """struct<kind, confidence>: .5 for each match of a kind's patterns, an article number counts 1 more for explicit ones; the
    first of equal kinds, confidence half the score, at most 1."""
    number = V.KIND_PATTERNS["explicit_article"][0]
    scores = F.array(*[F.struct((sum((_times(text, p) for p in ps), F.lit(0)) * 0.5 + (_times(text, number) if name == "explicit_article" else F.lit(0))).alias("score"), F.lit(name).alias("kind")) for name, ps in V.KIND_PATTERNS.items()])
    best = F.aggregate(scores, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("kind")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return F.struct(best["kind"].alias("kind"), F.least(F.lit(1.0), best["score"] / 2).alias("confidence"))


def concepts_asked(text: Column) -> Column:
    """Domain terms that the question holds, and the shorter pieces of such terms, sorted."""
    terms = tuple(w for ws in V.DOMAIN_TERMS.values() for w in ws)
    return F.array_sort(F.array_distinct(F.concat(held(text, terms), F.regexp_extract_all(text, F.lit(V.CONCEPT_PATTERN), F.lit(0)))))


def articles_asked(text: Column) -> Column:
    chinese = F.transform(F.regexp_extract_all(text, F.lit("第[ \\t\\n\\r]*([0-9]+)[ \\t\\n\\r]*條"), F.lit(1)), lambda n: F.concat(F.lit("第"), n, F.lit("條")))
    return F.concat(chinese, F.transform(F.regexp_extract_all(text, F.lit("(?i)article[ \\t\\n\\r]*([0-9]+)"), F.lit(1)), lambda n: F.concat(F.lit("Article "), n)))


def complexity(text: Column) -> Column:
    """Indicators, .3 for 100 characters and .2 for five concepts, in proportion below; at most 1."""
    said = sum((F.when(F.contains(text, F.lit(w)), x).otherwise(0.0) for w, x in V.COMPLEXITY), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), said + 0.3 * F.least(F.lit(1.0), F.length(text) / 100) + 0.2 * F.least(F.lit(1.0), F.size(concepts_asked(text)) / 5)), 6)


def analysed(questions: DataFrame) -> DataFrame:
    """questions(query_id, text) with kind, confidence, concepts, articles, complexity, strategies and features (length, words,
    question_mark, comparison, condition, negation, structure). A null text is empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    got = questions.select("query_id", t.alias("text"), kind(t).alias("_k"), concepts_asked(t).alias("concepts"), articles_asked(t).alias("articles"), complexity(t).alias("complexity"))
    suited = F.array().cast("array<string>")
    for name, strategies in V.STRATEGIES_OF.items():
        suited = F.when(F.col("_k.kind") == name, F.array(*[F.lit(s) for s in strategies])).otherwise(suited)
    more = lambda cond, *names: F.when(cond, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    strategies = F.array_sort(F.array_distinct(F.concat(suited, more(F.col("complexity") > 0.7, "multi_strategy", "adaptive_fusion"), more(F.size("concepts") > 3, "concept_expansion"), more(F.size("articles") > 0, "article_focused", "legal_structure"))))
    t = F.col("text")
    mark = any_of(t, ("?", "？"))
    structure = F.when(mark, "question").when(any_of(t, ("，", ",")), "compound").when(any_of(t, V.CONJUNCTION), "conjunction").otherwise("simple")
    features = F.struct(
        F.length(t).alias("length"), F.size(F.filter(F.split(t, "[ \\t\\n\\r\\f]+"), lambda w: w != "")).alias("words"), mark.alias("question_mark"),
        any_of(t, V.COMPARISON).alias("comparison"), any_of(t, V.CONDITION).alias("condition"), any_of(t, V.NEGATION).alias("negation"), structure.alias("structure"),
    )
    return got.select("query_id", "_k.kind", "_k.confidence", "concepts", "articles", "complexity", strategies.alias("strategies"), features.alias("features"))


def features(questions: DataFrame, synonyms: dict[str, tuple] = V.SYNONYMS) -> DataFrame:
    """(query_id, law, article_number, article_suffix, terms): what rule bonuses compare with; terms are canonical ones of which the
    question holds a variant. Empty law if none is named."""
    t = F.coalesce(F.col("text"), F.lit(""))
    law = F.coalesce(*[F.when(F.contains(t, F.lit(name)), name) for name in V.LAWS_ASKED], F.lit(""))
    number, suffix = T.article(t)
    terms = F.filter(F.array(*[F.when(any_of(t, words), F.lit(name)) for name, words in synonyms.items()]), lambda x: x.isNotNull())
    return questions.select("query_id", law.alias("law"), number.alias("article_number"), suffix.alias("article_suffix"), terms.alias("terms"))


def content_bonus(content: Column, terms: Column, most: float = 0.4) -> Column:
    """What a chunk's content adds to the rule bonus: an article's number .045, statute terms .01 each up to .12, and of the
    question's terms .025 for the canonical word and .015 for each variant."""
    low = F.lower(content)
    number = F.when(content.rlike("第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條"), 0.045).otherwise(0.0)
    words = F.least(F.lit(most * 0.3), sum((F.contains(low, F.lit(w)).cast("int") for w in V.STATUTE_TERMS), F.lit(0)) * 0.01)
    asked = F.lit(0.0)
    for name, variants in V.SYNONYMS.items():
        own = F.when(F.contains(low, F.lit(name)), 0.025).otherwise(0.0) + sum((F.when(F.contains(low, F.lit(v)), 0.015).otherwise(0.0) for v in variants), F.lit(0.0))
        asked = asked + F.when(F.array_contains(terms, name), own).otherwise(0.0)
    return F.round(F.least(F.lit(most), number + words + asked), 6)


def _finds(text: Column, words: tuple, concept: str, how: str, confidence: float) -> Column:
    return F.transform(held(text, words), lambda w: F.struct(F.lit(concept).alias("concept"), F.lit(how).alias("how"), w.alias("term"), F.lit(confidence).alias("confidence")))


def _found(text: Column) -> Column:
    """array<struct<concept, how, term, confidence>>: terms of legal concepts (1.0), everyday words for them (.8), in the tables' order."""
    return F.concat(*[_finds(text, words, name, how, x) for name, own, everyday, _ in V.REASONING_CONCEPTS for how, words, x in (("legal_term", own, 1.0), ("everyday_term", everyday, 0.8))])


def _fired(text: Column, known: Column) -> Column:
    """The same of the rules that fire: one of their words is there and their concept is not known yet."""
    return F.concat(*[F.when(~F.array_contains(known, name), _finds(text, words, name, "rule", x)).otherwise(F.slice(_finds(text, words, name, "rule", x), 1, 0)) for _, words, name, x, _ in V.REASONING_RULES])


def _rule_fires(words: tuple, concept: str) -> Column:
    return F.exists("fired", lambda x: (x["concept"] == concept) & x["term"].isin(*words))


def reasoned(questions: DataFrame) -> DataFrame:
    """(query_id, text, found, fired, articles, confidences, expanded) of questions(query_id, text).

    found and fired: array<struct<concept, how, term, confidence>>. articles: those of all concepts and fired rules, sorted.
    confidences: of the rules' concepts, the highest counts. expanded: the question, the concepts of each find and the
    conclusion of each fired rule, and the articles.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    got = questions.select("query_id", t.alias("text"), _found(F.lower(t)).alias("found"))
    got = got.withColumn("fired", _fired(F.lower("text"), F.transform("found", lambda x: x["concept"])))
    named = lambda column, name: F.exists(column, lambda x: x["concept"] == name)
    of_concepts = [F.when(named("found", name), F.array(*[F.lit(a) for a in articles])).otherwise(F.array().cast("array<string>")) for name, _, _, articles in V.REASONING_CONCEPTS]
    rule_fires = [(_rule_fires(words, name), name, articles) for _, words, name, _, articles in V.REASONING_RULES]
    of_rules = [F.when(fires, F.array(*[F.lit(a) for a in articles])).otherwise(F.array().cast("array<string>")) for fires, _, articles in rule_fires]
    conclusions = F.filter(F.array(*[F.when(fires, F.lit(name)) for fires, name, _ in rule_fires]), lambda x: x.isNotNull())
    pairs = F.array_distinct(F.transform("fired", lambda x: F.struct(x["concept"].alias("concept"), x["confidence"].alias("confidence"))))
    best = F.array_sort(F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["concept"] == p["concept"]) & (q["confidence"] > p["confidence"]))))
    got = got.withColumns({"articles": F.array_sort(F.array_distinct(F.concat(*of_concepts, *of_rules))), "confidences": best, "_c": conclusions})
    return got.withColumn("expanded", F.array_join(F.concat(F.array("text"), F.transform("found", lambda x: x["concept"]), "_c", "articles"), " ")).drop("_c")


def similarity(a: Column, b: Column, laws: tuple = tuple(V.LAW_VARIANTS)) -> Column:
    """How alike two questions are: 1 equal, .9 one in the other, .8 one article, .7 a common law, else .6 of their words' Jaccard."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    article = lambda t: F.regexp_extract(t, "第[ \\t\\n\\r]*([0-9]+(?:之[0-9]+)?)[ \\t\\n\\r]*條", 1)
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    both, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return (
        F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).when((article(a) != "") & (article(a) == article(b)), 0.8)
        .when(F.arrays_overlap(held(a, laws), held(b, laws)), 0.7).when(every > 0, F.round(both / every * 0.6, 6)).otherwise(0.0)
    )
