"""Graphs of legal concepts: building, embedding, search along paths; and concepts of documents merged by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.labels import any_of
from .metadata import _clause, clauses
from .retrieval import document_frequencies, index, small

#: Characters around a relation's evidence in which concepts are looked for, and around a concept in which articles are.
NEAR, ABOUT = 300, 200
#: Characters of a concept that are looked up by equality before the whole is compared.
GRAM = 4
#: Slices that a concept's occurrences are ranked in.
SLICES = 64
#: Bytes of text that a task takes apart before it gives out what it found there.
PIECE = 1 << 20


def walker(pattern: str):
    """A function from a text to the (start, end) of the pattern's matches, dots standing for line ends too.

    Patterns that are literals with `.*?` between them are walked by looking for one literal after the other: once one is not
    found there is no further match, so the walk is linear, where a search would run to the end from every first literal.
    """
    parts = pattern.split(".*?")
    if not all(part and re.escape(part) == part for part in parts):
        searched = re.compile(pattern, re.S)
        return lambda text: (m.span() for m in searched.finditer(text))

    def walk(text: str):
        at = 0
        while True:
            start = end = text.find(parts[0], at)
            for part in parts:
                found = text.find(part, end) if end >= 0 else -1
                if found < 0:
                    return
                end = found + len(part)
            yield start, end
            at = end

    return walk


def occurrences(docs: DataFrame, concepts: tuple = V.GRAPH_CONCEPTS, relations: tuple = V.GRAPH_RELATIONS) -> DataFrame:
    """(doc_id, is_relation, name, kind, importance, template, pattern, at, said, around) of docs(doc_id, content): matches of concept
    templates and of relation patterns, which may span lines, with the text around them.

    Where a match stands no built-in function tells, so texts are walked in Arrow batches where they lie, about PIECE bytes at once;
    nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, is_relation boolean, name string, kind string, importance double, template int, pattern int, at int, said string, around string").schema
    out = to_arrow_schema(schema)
    ready = [(False, name, what, weight, i, j, p) for i, (name, what, weight, ps) in enumerate(concepts) for j, p in enumerate(ps)]
    ready += [(True, name, "", 0.0, i, j, p) for i, (name, ps) in enumerate(relations) for j, p in enumerate(ps)]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        walks = [(*told, walker(p)) for *told, p in ready]
        for batch in batches:
            load = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + PIECE, "right")))
                piece, rows = batch.slice(i, j - i), []
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    for rel, name, what, weight, t, n, walk in walks if text else ():
                        width = NEAR if rel else ABOUT
                        rows += [(key, rel, name, what, weight, t, n, s, text[s:e].strip(), text[max(0, s - width) : e + width]) for s, e in walk(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(out), out)], schema=out)
                i = j

    return docs.select("doc_id", "content").mapInArrow(run, schema)


def nodes(found: DataFrame) -> DataFrame:
    """(concept, name, kind, importance, content, articles, first): one row per distinct concept text, case and margins apart.

    concept is the text in lower case; name, kind, importance and content are those of its first occurrence, by document,
    template, pattern and place; articles are all that its occurrences have around them, sorted.
    """
    rows = found.where("NOT is_relation AND said <> ''").withColumn("concept", F.lower("said"))
    numbers = F.transform(F.regexp_extract_all("around", F.lit("第[ \\t\\n\\r]*([0-9]+)[ \\t\\n\\r]*條"), F.lit(1)), lambda n: F.concat(F.lit("第"), n, F.lit("條")))
    first = F.struct("doc_id", "template", "pattern", "at")
    one = rows.withColumn("n", numbers).groupBy("concept").agg(F.min_by(F.struct("name", "kind", "importance", F.col("said").alias("content")), first).alias("v"), F.min(first).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("n")))).alias("articles"))
    return one.select("concept", "v.*", "articles", "first")


def edges(found: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): around each relation's evidence, every concept that stands there leads to the next one in the order of
    nodes(). Of equal (src, dst, type) the highest confidence counts; of several types of a pair the one that came up last.

    Confidence: evidence length / 50 plus half the share of the surroundings' words that the evidence has, at most 1. Concepts are
    found by an equality join on their first characters, so no text meets all concepts.
    """
    rows = found.where("is_relation").withColumn("r", F.struct("doc_id", "template", "pattern", "at"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    share = F.size(F.array_intersect(words("around"), words("said"))) / F.greatest(F.size(words("around")), F.lit(1))
    rows = rows.select("r", F.col("name").alias("type"), "around", F.round(F.least(F.lit(1.0), F.length("said") / 50 + 0.5 * share), 6).alias("confidence"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.length("around")), lambda i: F.substring("around", i, n)))))
    asked = rows.withColumn("gram", F.explode(grams))
    looked = known.select("concept", "content", "first", F.substring("content", 1, GRAM).alias("gram"))
    meets = asked.join(looked, "gram").where(F.contains("around", "content")).select("r", "type", "confidence", "concept", "first").distinct()
    pairs = meets.withColumn("dst", F.lead("concept").over(Window.partitionBy("r", "type").orderBy("first"))).where("dst IS NOT NULL")
    pairs = pairs.withColumn("order", F.struct("r.doc_id", "r.template", "r.pattern", "r.at", "first"))
    typed = pairs.groupBy(F.col("concept").alias("src"), "dst", "type").agg(F.max("confidence").alias("confidence"), F.min("order").alias("since"))
    last = F.max_by(F.struct("type", "confidence"), "since")
    return typed.groupBy("src", "dst").agg(last.alias("v")).select("src", "dst", "v.type", "v.confidence")


def embeddings(known: DataFrame) -> DataFrame:
    """(concept, term, weight): L2-normalised TF-IDF vectors of the concepts' texts."""
    indexed = index(known.select("concept", "content"), ["concept"])
    n = indexed.agg(F.count("*").alias("n"))
    idf = document_frequencies(indexed).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = indexed.select("concept", F.explode("terms").alias("t")).select("concept", "t.term", "t.tf").join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = rows.groupBy("concept").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return rows.join(length, "concept").select("concept", "term", F.round(F.col("w") / F.col("len"), 6).alias("weight"))


def concepts_of(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, concept): concepts that hold a word of the question, share a legal keyword with it, or whose name's words it holds.

    The stated questions, few by count, meet all concepts in one pass.
    """
    q = questions.select("query_id", F.lower("text").alias("q")).withColumn("words", F.filter(F.split("q", "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    text = F.lower("content")
    holds = F.exists("words", lambda w: F.contains(text, w))
    shared = F.lit(False)
    for word in V.GRAPH_KEYWORDS:
        shared = shared | (F.contains("q", F.lit(word)) & F.contains(text, F.lit(word)))
    named = F.exists(F.split("name", "_"), lambda w: F.contains("q", w))
    return known.join(small(q), holds | shared | named).select("query_id", "concept")


def search(questions: DataFrame, known: DataFrame, links: DataFrame, k: int = 5, hops: int = 3, most: int = 10) -> DataFrame:
    """(query_id, concept, path, score, rank): concepts along the best paths from a question's concepts.

    Paths are simple, of at most `hops` edges; a question keeps the `most` longest, of equal ones those of highest mean
    importance, then by text. Their concepts are taken path by path, repeats too, until there are k. A concept scores .6 of its importance and .4 of
    its path's mean confidence.
    """
    weight = known.select(F.col("concept").alias("dst"), "importance")
    hop = links.join(weight, "dst").select("src", "dst", "confidence", "importance")
    front = concepts_of(questions, known).join(known.select("concept", "importance"), "concept").select("query_id", F.array("concept").alias("path"), F.array("importance").alias("weights"), F.array().cast("array<double>").alias("steps"))
    found = None
    order = Window.partitionBy("query_id").orderBy(F.desc(F.size("path")), F.desc("mean"), "name")
    for _ in range(hops):
        front = front.join(hop, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = front.select("query_id", F.concat("path", F.array("dst")).alias("path"), F.concat("weights", F.array("importance")).alias("weights"), F.concat("steps", F.array("confidence")).alias("steps"))
        found = front if found is None else found.unionByName(front)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ranked = found.distinct().withColumns({"mean": F.round(total("weights") / F.size("path"), 6), "name": F.array_join("path", ">")}).withColumn("p", F.row_number().over(order)).where(F.col("p") <= most)
    each = ranked.select("query_id", "p", "name", F.round(total("steps") / F.size("steps"), 6).alias("along"), F.posexplode(F.arrays_zip("path", "weights")).alias("pos", "c"))
    taken = each.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("p", "pos"))).where(F.col("n") <= k)
    scored = taken.select("query_id", F.col("c.path").alias("concept"), F.col("name").alias("path"), F.round(0.6 * F.col("c.weights") + 0.4 * F.col("along"), 6).alias("score"), "n")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "n"))).drop("n")


# --- concepts of documents, merged by name ---------------------------------------------------------------------------------------------
#: Fixed values: (kind, pattern for one clause, confidence); the first group names the concept.
EXTRACTED = (
    ("權利定義", "(.+)(?:專有|享有|具有)(.*)權利", 0.9), ("權利定義2", "(.+)權[利]?(?:是指|係指|為)(.*)", 0.9), ("義務定義", "(.+)(?:應|必須|得|可以)(.*)", 0.8),
    ("例外條件", "(?:但|惟|例外|除外)(.*)", 0.7), ("法律後果", "(?:違反|侵害|侵犯)(.*)(?:者|時)(.*)", 0.8), ("適用條件", "(?:於|在)(.*)(?:情形|情況|條件)(.*)", 0.6),
)
#: Fixed values: (type, pattern for one clause, confidence); the groups are source and target.
LINKED = (
    ("權利義務", "(.+)專有(.+)權利", 0.8), ("權利義務", "(.+)享有(.+)權利", 0.8), ("權利義務", "(.+)應(.+)", 0.8), ("權利義務", "(.+)必須(.+)", 0.8),
    ("包含", "(.+)包括(.+)", 0.7), ("包含", "(.+)含(.+)", 0.7), ("包含", "(.+)涵蓋(.+)", 0.7), ("條件", "(.+)時(.+)", 0.6), ("條件", "(.+)情形(.+)", 0.6), ("條件", "(.+)條件(.+)", 0.6),
)
#: Domains of concepts by keywords, and words without meaning in a concept's name.
EXTRACT_DOMAINS = {
    "著作權": ("著作", "著作權", "版權", "重製", "改作", "散布", "公開傳輸", "公開演出", "公開展示", "出租", "衍生著作", "編輯著作"),
    "商標權": ("商標", "商標權", "註冊", "使用", "近似", "混淆", "著名商標"),
    "專利權": ("專利", "發明", "新型", "新式樣", "技術", "創新", "實施"),
}
MEANINGLESS = "[的在於為是有及與或但惟]"


def _name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[，。；：！？ \\t\\n\\r\\f]+", ""), MEANINGLESS, "")


def extracted(chunks: DataFrame) -> DataFrame:
    """(concept, kind, confidence, domain, articles, contexts, n): concepts of chunks(chunk_id, content), merged by name in lower case.

    Concepts are named by clause patterns (names of under two characters go) and by domain keywords (.6). Of a concept the
    surest occurrence counts, of equal ones the first by chunk, rule and clause; articles are those of all its chunks, sorted;
    contexts the clauses of its first three occurrences. The domain is the first one with a keyword in the chunk, else 其他.
    A common concept's occurrences are ranked in slices by chunk; only the first three of each slice meet in one task.
    """
    domain = F.coalesce(*[F.when(any_of(F.col("content"), words), F.lit(name)) for name, words in EXTRACT_DOMAINS.items()], F.lit("其他"))
    articles = F.array_distinct(F.regexp_extract_all("content", F.lit("第[0-9]+(?:-[0-9]+)?條"), F.lit(0)))
    rows = chunks.select("chunk_id", "content", domain.alias("domain"), articles.alias("articles"))
    by_rule = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(x).alias("confidence"), _name(F.regexp_extract("clause", _clause(p), 1)).alias("name")) for i, (kind, p, x) in enumerate(EXTRACTED)])
    named = clauses(rows, "chunk_id", "domain", "articles").select("chunk_id", "domain", "articles", "pos", F.col("clause").alias("context"), F.explode(by_rule).alias("f")).where(F.length("f.name") >= 2)
    named = named.select("chunk_id", "domain", "articles", "pos", "context", "f.*")
    words = [(d, w) for d, ws in EXTRACT_DOMAINS.items() for w in ws]
    held = F.filter(F.array(*[F.struct(F.lit(len(EXTRACTED) + i).alias("rule"), F.lit(w).alias("name"), F.lit(d).alias("d")) for i, (d, w) in enumerate(words)]), lambda x: F.contains("content", x["name"]))
    at = F.greatest(F.instr("content", F.col("h.name")) - 51, F.lit(0))
    by_word = rows.select("chunk_id", "content", "articles", F.explode(held).alias("h")).select("chunk_id", F.col("h.d").alias("domain"), "articles", F.lit(0).alias("pos"), F.substring("content", at + 1, F.lit(100) + F.length("h.name")).alias("context"), "h.rule", F.lit("關鍵詞").alias("kind"), F.lit(0.6).alias("confidence"), "h.name")
    every = named.unionByName(by_word)
    order = F.struct("chunk_id", "rule", "pos")
    told = every.withColumn("concept", F.lower("name"))
    sliced = told.select("concept", "chunk_id", "rule", "pos", "context", F.pmod(F.xxhash64("chunk_id"), F.lit(SLICES)).alias("slice"))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id", "rule", "pos"))
    few = sliced.withColumn("i", first("concept", "slice")).where("i <= 3").withColumn("i", first("concept")).where("i <= 3")
    best = F.min_by(F.struct("kind", "confidence", "domain"), F.struct(-F.col("confidence"), order))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "context"))), lambda x: x["context"]), " | ")
    merged = told.groupBy("concept").agg(best.alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("articles")))).alias("articles"), F.count("*").alias("n"))
    return merged.join(few.groupBy("concept").agg(context.alias("contexts")), "concept").select("concept", "v.*", "articles", "contexts", "n")


def linked(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pos, source, target, type, confidence): relations between the parts of a clause; reasoning rules are read off them."""
    found = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(x).alias("confidence"), F.trim(F.regexp_extract("clause", _clause(p), 1)).alias("source"), F.trim(F.regexp_extract("clause", _clause(p), 2)).alias("target")) for kind, p, x in LINKED])
    each = clauses(chunks, "chunk_id").select("chunk_id", "pos", F.explode(found).alias("f"))
    return each.where("f.source <> '' AND f.target <> ''").select("chunk_id", "pos", "f.source", "f.target", "f.type", "f.confidence")


def article_map(merged: DataFrame) -> DataFrame:
    """(article, n, concepts): the concepts of each article, sorted."""
    return merged.select("concept", F.explode("articles").alias("article")).groupBy("article").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("concept")).alias("concepts"))
