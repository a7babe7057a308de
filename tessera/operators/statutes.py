"""Structured statutes: lines to a flat tree of parts, and texts, chunks and searches from it.

The tree stays flat: one row per part with the labels of everything above it. Lines carry their open headings forward with
windows inside a document, so documents are independent of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import any_of, number
from ..functions.text import article as article_numbers
from ..functions.text import cn_numeral, let, line_class
from ..sources import stored
from .set_join import small

LEVELS = ("chapter", "section", "article", "paragraph", "subparagraph", "item")
#: Granularity level of each kind of part.
GRANULARITY = {"law": "document", "chapter": "document_component", "section": "basic_unit_hierarchy", "article": "basic_unit", "paragraph": "basic_unit_component", "subparagraph": "enumeration", "item": "enumeration"}


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, kind) of the non-blank lines."""
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc_id", "line_no", F.trim("raw").alias("line")).where(F.col("line") != "")
    return raw.withColumn("kind", line_class(F.col("line")))


#: Words of amendments, of what follows them, and of effective dates.
AMENDS = ("修正", "施行", "生效", "民國", "年", "月", "日")
GOES_ON = (*AMENDS, "政院", "條文", "增訂", "刪除")
EFFECTIVE, PLACES = ("政院", "施行日期", "定之", "修正之第"), ("第", "條", "章", "節")


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without what only tells of amendments and effective dates: dates of amendment, states of effect, the name line,
    stray lines on effect, and numbered lists of amendments with all lines that go on about them. Leading blank lines go, too.

    A list runs from a numbered line with a word of amendment to the first line that is neither blank nor numbered nor holds
    such a word: its lines are those whose last beginning stands behind the last line that ends lists.
    """
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", "^[ \\t\\r\u3000]+|[ \\t\\r\u3000]+$", ""))
    line = F.col("line")
    numbered = line.rlike("^[0-9]+[.]")
    starts, goes_on = numbered & any_of(line, AMENDS), (line == "") | numbered | any_of(line, GOES_ON)
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda cond: F.coalesce(F.last(F.when(cond, F.col("line_no")), True).over(by), F.lit(-1))
    gone = line.rlike("^修正日期：民國[ \\t]*[0-9]+[ \\t]*年[ \\t]*[0-9]+[ \\t]*月[ \\t]*[0-9]+[ \\t]*日") | any_of(line, ("※本法規部分或全部條文尚未生效", "生效狀態：")) | F.startswith(line, F.lit("法規名稱：")) | (any_of(line, EFFECTIVE) & ~any_of(line, PLACES))
    kept = raw.withColumn("gone", gone | (last(starts) > last(~goes_on))).where("NOT gone")
    some = F.max(F.when(line != "", F.lit(1)).otherwise(0)).over(by)
    return kept.withColumn("some", some).where("some = 1").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, node, kind, chapter, section, article, paragraph, subparagraph, item, content): one row per opened part.

    A paragraph line counts only inside an article, a subparagraph only inside a paragraph, an item only inside a
    subparagraph; otherwise it is content. Content goes to the deepest open part.
    """
    got = lines(docs)
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)

    def opened(df: DataFrame, kind: str, above: str | None) -> DataFrame:
        here = (F.col("kind") == kind) & (F.col(f"_{above}").isNotNull() if above else F.lit(True))
        upper = {"section": ["chapter"], "article": ["chapter", "section"]}.get(kind, LEVELS[2 : LEVELS.index(kind)] if above else [])
        since = F.last(F.when(here, F.col("line_no")), True).over(by)
        reset = [F.last(F.when(F.col("kind") == u, F.col("line_no")), True).over(by) if u in ("chapter", "section", "article") else F.col(f"_{u}") for u in upper]
        out = df.withColumn(f"_{kind}", since)
        for r in reset:  # a part closes when one above it opens later, or closes
            after = F.col(f"_{kind}") > r
            out = out.withColumn(f"_{kind}", F.when(after | r.isNull() if not above else after, F.col(f"_{kind}")))
        return out.withColumn("kind", F.when((F.col("kind") == kind) & ~here, "content").otherwise(F.col("kind")))

    for kind, above in zip(LEVELS, (None, None, None, "article", "paragraph", "subparagraph")):
        got = opened(got, kind, above)
    label = {k: F.last(F.when((F.col("kind") == k) & (F.col("line_no") == F.col(f"_{k}")), F.col("line")), True).over(by) for k in LEVELS}
    got = got.withColumns({k: F.when(F.col(f"_{k}").isNotNull(), c) for k, c in label.items()})
    node = F.last(F.when(F.col("kind") != "content", F.col("line_no")), True).over(by)
    got = got.withColumn("node", F.coalesce(node, F.lit(-1)))
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "kind", "line"))), lambda x: x["kind"] == "content"), lambda x: x["line"]), "\n")
    first = [F.min_by(k, "line_no").alias(k) for k in ("kind", *LEVELS)]
    return got.groupBy("doc_id", "node").agg(*first, text.alias("content"))


def tree(nodes: DataFrame) -> DataFrame:
    """Path, parent path and granularity level of every part."""
    path = F.concat_ws("/", *LEVELS)
    level = F.lit(None).cast("string")
    for kind, name in GRANULARITY.items():
        level = F.when(F.col("kind") == kind, name).otherwise(level)
    cut = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return nodes.where(F.col("kind") != "content").select("doc_id", "node", path.alias("path"), cut.alias("parent"), level.alias("level"))


def search(nodes: DataFrame, **wanted: str) -> DataFrame:
    """Parts whose labels match all the given ones, deepest first."""
    cond = F.lit(True)
    for kind, label in wanted.items():
        cond = cond & (F.col(kind) == label)
    depth = sum((F.col(k).isNotNull().cast("int") for k in LEVELS), F.lit(0))
    return nodes.where(cond).withColumn("depth", depth)


def linear_text(nodes: DataFrame) -> DataFrame:
    """The statute's text again, headings and contents in order, blank parts dropped."""
    heading = F.coalesce(*[F.col(k) for k in reversed(LEVELS)], F.lit(""))
    piece = F.concat_ws("\n", F.when(heading != "", heading), F.when(F.col("content") != "", F.col("content")))
    return nodes.select("doc_id", "node", piece.alias("piece")).where("piece != ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))


def node_id(law: Column, *labels: Column) -> Column:
    """Law and the numbers of the labels below it, joined by hyphens, 0 where there is none."""
    number = lambda c: F.when(F.regexp_extract(c, "第\\s*([^章節條\\s]+)", 1) != "", F.regexp_extract(c, "第\\s*([^章節條\\s]+)", 1)).otherwise("0")
    return F.concat_ws("-", law, *[F.coalesce(number(c), F.lit("0")) for c in labels])


#: What stands in place of a repealed article.
REPEALED = ("（刪除）", "(刪除)")


def multi_level(nodes: DataFrame, deep: bool = True, whole_articles: bool = True) -> DataFrame:
    """One chunk for the law and for every part of it: (doc_id, chunk_index, level, path, content, context).

    A part's content is its own heading and text and those of all parts below it, in order. deep: also paragraphs and
    below, with their article's own text as context. whole_articles: articles hold what is below them. Repealed articles
    and the parts below them have no chunk of their own. A part meets its at most six parts above in one shuffle.
    """
    order = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    opened = nodes.where(F.col("kind") != "content").withColumns({f"_{k}": F.when(F.col(k).isNotNull(), F.last(F.when(F.col("kind") == k, F.col("node")), True).over(order)) for k in LEVELS})
    own = F.concat_ws("\n", F.coalesce(*[F.col(k) for k in reversed(LEVELS)]), F.when(F.col("content") != "", F.col("content")))
    article = F.last(F.when(F.col("kind") == "article", F.struct(own.alias("text"), F.trim("content").isin(*REPEALED).alias("gone"))), True).over(order)
    opened = opened.withColumns({"own": own, "of": F.when(F.col("_article").isNotNull(), article)})
    above = F.filter(F.array(F.lit(-1), *[F.col(f"_{k}") for k in LEVELS]), lambda a: a.isNotNull())
    pieces = opened.select("doc_id", "node", "kind", "own", "_article", F.explode(above).alias("anchor"))
    if not whole_articles:
        pieces = pieces.where((F.col("kind").isin(*LEVELS[:3])) | ~F.col("anchor").eqNullSafe(F.col("_article")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "own"))), lambda p: p["own"]), "\n")
    texts = pieces.groupBy("doc_id", "anchor").agg(text.alias("content"))
    inner = F.col("kind").isin(*LEVELS[3:])
    heads = opened.where(~F.coalesce(F.col("of.gone"), F.lit(False)) & (F.lit(deep) | ~inner))
    heads = heads.select("doc_id", F.col("node").alias("anchor"), F.col("kind").alias("level"), F.concat_ws("/", *LEVELS).alias("path"), F.when(inner, F.col("of.text")).alias("context"))
    laws = nodes.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("anchor"), F.lit("law").alias("level"), F.lit("").alias("path"), F.lit(None).cast("string").alias("context"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("anchor")) - 1
    return heads.unionByName(laws).join(texts, ["doc_id", "anchor"]).select("doc_id", index.alias("chunk_index"), "level", "path", "content", "context")


#: What tells that a short part already says what its article is about.
MAIN_TEXT = ("本法.*?定義", "本法.*?規定", "本法.*?用詞", "應.*?申請", "得.*?辦理", "依.*?程序")
SHORT = 200


def six_levels(chunks: DataFrame) -> DataFrame:
    """The chunks of multi_level with their granularity; a short item without main text follows its article's own text.

    Adds level (document to enumeration; the kind of part stays as `part`), original (the content before) and in_context.
    """
    level = F.coalesce(*[F.when(F.col("level") == kind, name) for kind, name in GRANULARITY.items()], F.lit("basic_unit"))
    alone = (F.col("level") == "item") & (F.length("content") < SHORT) & ~F.col("content").rlike("|".join(MAIN_TEXT)) & F.col("context").isNotNull()
    text = F.when(alone, F.concat_ws("\n", "context", "content")).otherwise(F.col("content"))
    return chunks.select("doc_id", "chunk_index", level.alias("level"), F.col("level").alias("part"), "path", text.alias("content"), F.col("content").alias("original"), F.coalesce(alone, F.lit(False)).alias("in_context"))


#: Words in a label that weigh an article, and by how much.
WEIGHTS = (
    ("chapter", "總則|第一章|通則", 1.5),
    ("article", "定義|用詞|釋義", 1.3),
    ("chapter", "罰", 1.2),
    ("chapter", "施行|程序|流程", 0.8),
    ("chapter", "附", 0.7),
    ("section", "通則", 1.2),
)


def importance(chapter: Column, section: Column, article: Column) -> Column:
    """Weight of an article by its labels: the product of all the weights that apply."""
    labels = {"chapter": chapter, "section": section, "article": article}
    product = F.lit(1.0)
    for label, pattern, weight in WEIGHTS:
        product = product * F.when(labels[label].rlike(pattern), weight).otherwise(1.0)
    return F.round(product, 2)


# --- statutes as trees (JSON) ---------------------------------------------------------------------------------------------------------
PREFIX, UNMARKED, UNSORTED = "法規名稱：", "未標示條文", ("未分類章", "未分類節")


def tree_nodes(documents: DataFrame) -> DataFrame:
    """(doc_id, law, chapter, section, article, paragraph, subparagraph, item, kind, place, title, content, id) of documents(doc_id, laws): one row
    for each law, chapter, section, article and part below it, in the order of place (array of positions).

    Older names (items, sub_items) are read where the newer ones (paragraphs, subparagraphs) are missing or empty; several
    documents, each with several laws, are one table, which is all that merging them takes. A document is walked once, inside its
    row: its nodes are one array, which is then exploded.
    """
    part = lambda title: lambda x: F.struct(F.coalesce(*[x[t] for t in title]).alias("title"), x["content"].alias("content"), x["metadata"]["id"].alias("id"))
    inner = lambda q, name: F.struct(part([name])(q).alias("self"), F.transform(F.coalesce(q["items"], F.array()), part(["item"])).alias("below"))
    outer = lambda p, name, subs, sub: F.struct(part([name])(p).alias("self"), F.transform(F.coalesce(p[subs], F.array()), lambda q: inner(q, sub)).alias("below"))
    new = lambda article: F.transform(article["paragraphs"], lambda p: outer(p, "paragraph", "subparagraphs", "subparagraph"))
    old = lambda article: F.transform(article["items"], lambda p: outer(p, "item", "sub_items", "sub_item"))
    empty, kinds = F.lit(None).cast("string"), ("law", *LEVELS)
    #: Of each kind: its title, content, id, and what lies below it.
    told = {
        "law": lambda x: (x["law_name"], empty, empty, x["chapters"]), "chapter": lambda x: (x["chapter"], empty, empty, x["sections"]), "section": lambda x: (x["section"], empty, empty, x["articles"]),
        "article": lambda x: (x["article"], x["content"], x["metadata"]["id"], F.when(F.size(x["paragraphs"]) > 0, new(x)).otherwise(old(x))),
        "paragraph": lambda x: (x["self"]["title"], x["self"]["content"], x["self"]["id"], x["below"]), "subparagraph": lambda x: (x["self"]["title"], x["self"]["content"], x["self"]["id"], x["below"]), "item": lambda x: (x["title"], x["content"], x["id"], None),
    }

    def walk(xs: Column, names: tuple = (), at: tuple = ()) -> Column:
        kind = kinds[len(names)]

        def one(x: Column, i: Column) -> Column:
            title, content, id_, below = told[kind](x)
            mine, place = (*names, title), (*at, i)
            labels = [(mine[j] if j < len(mine) else empty).alias(k) for j, k in enumerate(kinds)]
            node = F.array(F.struct(*labels, F.lit(kind).alias("kind"), F.array(*place).alias("place"), title.alias("title"), F.coalesce(content, F.lit("")).alias("content"), id_.alias("id")))
            return node if below is None else F.concat(node, F.coalesce(walk(below, mine, place), F.slice(node, 1, 0)))

        return F.flatten(F.transform(xs, one))

    return documents.select("doc_id", F.inline(walk(F.col("laws"))))


def tree_text(nodes: DataFrame, glue: str = "\n\n") -> DataFrame:
    """(doc_id, text): titles and contents of tree_nodes() in order, blank ones dropped."""
    pieces = nodes.select("doc_id", "place", F.filter(F.array(F.coalesce("title", F.lit("")), "content"), lambda s: F.trim(s) != "").alias("said")).where(F.size("said") > 0)
    listed = F.array_sort(F.collect_list(F.struct("place", "said")))
    return pieces.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(listed, lambda x: x["said"])), glue).alias("text"))


def normalised(nodes: DataFrame) -> DataFrame:
    """tree_nodes() from articles down with the metadata that evaluation needs: (doc_id, place, kind, title, content, id, category, article_label,
    article_number, article_suffix, item_number, clause_type, clause_number).

    Names and ids lose the prefix 法規名稱：. Articles without a label, and unnumbered ones that describe the law, go with all below
    them; chapters and sections that are left empty have no rows.
    """
    plain = lambda c: F.replace(F.col(c), F.lit(PREFIX), F.lit(""))
    label, suffix = article_numbers(F.col("article"))
    rows = nodes.where(F.col("kind").isin("article", "paragraph", "subparagraph", "item")).withColumns({"article_number": label, "article_suffix": suffix, "_at": F.slice("place", 1, 4)})
    fake = (F.col("article") == UNMARKED) | (F.col("article_number").isNull() & F.contains("content", F.lit("法規名稱")))
    dropped = rows.where((F.col("kind") == "article") & F.coalesce(fake, F.lit(False))).select("doc_id", "_at")
    kept = rows.join(dropped, ["doc_id", "_at"], "left_anti")
    sub = F.col("kind") == "subparagraph"
    return kept.select(
        "doc_id", "place", "kind", "title", "content", plain("id").alias("id"), plain("law").alias("category"), F.col("article").alias("article_label"), "article_number", "article_suffix",
        F.when(F.col("kind") == "paragraph", number(F.col("title"))).alias("item_number"), F.when(sub, "目").alias("clause_type"), F.when(sub, number(F.col("title"))).alias("clause_number"),
    )


def relabelled(nodes: DataFrame) -> DataFrame:
    """tree_nodes() with subparagraphs titled 一, 二, ... and items (一), (二), ... by their order, where a title lacks a numeral."""
    at = F.element_at("place", -1) + 1
    plain = F.coalesce(F.col("title"), F.lit(""))
    inner = F.regexp_extract(plain, "([一二三四五六七八九十]+)", 1)
    name = F.when(inner != "", inner).otherwise(cn_numeral(at))
    title = F.when(F.col("kind") == "subparagraph", name).when(F.col("kind") == "item", F.concat(F.lit("("), name, F.lit(")"))).otherwise(F.col("title"))
    return nodes.withColumn("title", title)


def unit_chunks(nodes: DataFrame, unit: str = "article", context: bool = True) -> DataFrame:
    """(doc_id, chunk_index, place, content): one chunk for each law, chapter, section, article or part of tree_nodes().

    A chunk starts with 【law】 and, if context is asked for, the titles above the unit, then titles and contents of the unit and of
    all below it, a line each. Repealed articles are left out with all below them, unclassified titles too.
    """
    depth = {"law": 1, "chapter": 2, "section": 3, "article": 4, "paragraph": 5, "subparagraph": 6, "item": 7}[unit]
    # dealt by document once: the window, the groups and the order all lie inside one
    rows = relabelled(nodes).repartition("doc_id").withColumn("_at", F.slice("place", 1, 4))
    repealed = F.max((F.col("kind") == "article") & F.trim("content").isin(*REPEALED)).over(Window.partitionBy("doc_id", "_at"))
    rows = rows.withColumn("_gone", repealed).where(~F.col("_gone") & (F.size("place") >= depth))
    titled = F.when(F.coalesce("title", F.lit("")).isin("", *UNSORTED), None).otherwise(F.col("title"))
    said = F.filter(F.array(F.when(F.col("kind") != "law", titled), F.when(F.trim("content") != "", F.col("content"))), lambda s: s.isNotNull())
    pieces = rows.select("doc_id", F.slice("place", 1, depth).alias("unit"), "place", said.alias("said"), "law", *[F.when(F.col(k).isin(*UNSORTED), None).otherwise(F.col(k)).alias(k) for k in LEVELS])
    above = [k for k in LEVELS[: depth - 2]] if context and depth > 2 else []
    head = F.filter(F.array(F.concat(F.lit("【"), F.coalesce("law", F.lit("")), F.lit("】")), *above), lambda s: s.isNotNull())
    texts = pieces.groupBy("doc_id", "unit").agg(F.min_by(head, "place").alias("head"), F.array_sort(F.collect_list(F.struct("place", "said"))).alias("rows"))
    content = F.array_join(F.concat("head", F.flatten(F.transform("rows", lambda x: x["said"]))), "\n")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit")) - 1
    return texts.select("doc_id", index.alias("chunk_index"), F.col("unit").alias("place"), content.alias("content"))


def node_chunks(nodes: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_id, content): contents of articles and parts, each node a chunk named by its titles, ARTICLE_main for an article's own
    text; contents over `size` in windows that overlap, named .._part_n from 1."""
    named = F.concat_ws("_", "article", "paragraph", "subparagraph", "item")
    rows = nodes.where((F.col("content") != "") & F.col("article").isNotNull()).select("doc_id", named.alias("base"), "kind", "content", F.length("content").alias("n"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - min(overlap, size - 1) - 1), F.lit(size - min(overlap, size - 1))))
    cut = rows.select("doc_id", "base", "kind", "content", "n", F.posexplode(starts).alias("i", "s"))
    name = F.when(F.col("n") > size, F.concat(F.col("base"), F.lit("_part_"), (F.col("i") + 1).cast("string"))).when(F.col("kind") == "article", F.concat(F.col("base"), F.lit("_main"))).otherwise(F.col("base"))
    return cut.select("doc_id", name.alias("chunk_id"), F.substring("content", F.col("s") + 1, F.lit(size)).alias("content"))


def cited(citation: Column) -> Column:
    """struct<law, chapter, section, article, paragraph, subparagraph, item>: the numbers that a citation names, N or N-M for articles, and what is
    left as the law's name; empty strings are null."""
    from ..functions.labels import NUM, first_group

    units = {"chapter": "章", "section": "節", "paragraph": "項", "subparagraph": "款", "item": "目"}

    def found(t: Column) -> Column:
        main, suffix = first_group(t, f"第({NUM})條"), first_group(t, f"第{NUM}條之({NUM})", f"第{NUM}條-({NUM})")
        plain = {k: number(first_group(t, f"第({NUM}){u}")).cast("string") for k, u in units.items()}
        article = F.when(main.isNotNull(), F.concat_ws("-", number(main).cast("string"), number(suffix).cast("string")))
        rest = F.trim(F.regexp_replace(t, f"第{NUM}[章節條項款目](?:[之-]{NUM})?", ""))
        return F.struct(F.when(rest != "", rest).alias("law"), plain["chapter"].alias("chapter"), plain["section"].alias("section"), article.alias("article"), plain["paragraph"].alias("paragraph"), plain["subparagraph"].alias("subparagraph"), plain["item"].alias("item"))

    return let(F.regexp_replace(citation, "[ \\t\u3000]+", ""), found)


def citation_search(nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, doc_id, place, kind, rank): tree_nodes() that agree with every part that citations(query_id, citation) name; the coarsest first,
    then by document and place. An equality join on the article where one is named; other citations meet the nodes by their law.

    Nodes are read once, and each of their labels is parsed once, however many nodes bear it. Of either join the citations are the
    side that travels, if a count shows that they are few: nodes never pass the driver.
    """
    from ..functions.labels import level_info

    known = stored(nodes.select("doc_id", "place", "kind", F.replace("law", F.lit(PREFIX), F.lit("")).alias("plain"), *LEVELS))
    labels = known.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("label")) for k in LEVELS])).alias("x")).select("x.*").where("label IS NOT NULL").distinct()
    keys = stored(labels.withColumn("key", F.coalesce(*[F.when(F.col("level") == k, level_info(F.col("label"), k)["key"]) for k in LEVELS])).where("key IS NOT NULL"))
    for k in LEVELS:
        known = known.join(small(keys.where(F.col("level") == k).select(F.col("label").alias(k), F.col("key").alias(f"k_{k}"))), k, "left")
    asked = stored(citations.select("query_id", cited(F.col("citation")).alias("c")))
    ok = F.lit(True)
    for k in LEVELS:
        ok = ok & (F.col(f"c.{k}").isNull() | F.coalesce(F.col(f"k_{k}") == F.col(f"c.{k}"), F.lit(False)))
    ok = ok & (F.col("c.law").isNull() | F.coalesce(F.contains("plain", F.col("c.law")), F.lit(False)))
    by_article = known.where("k_article IS NOT NULL").join(small(asked.where("c.article IS NOT NULL").withColumn("k_article", F.col("c.article"))), "k_article").where(ok)
    others = known.join(small(asked.where("c.article IS NULL")), ok)
    found = by_article.select("query_id", "doc_id", "place", "kind").unionByName(others.select("query_id", "doc_id", "place", "kind"))
    order = Window.partitionBy("query_id").orderBy(F.size("place"), "doc_id", "place")
    return found.withColumn("rank", F.row_number().over(order))


def level_histogram(chunks: DataFrame) -> DataFrame:
    """(level, n): chunks(level) by granularity level, levels without a chunk too."""
    from .fusion import LEVEL_WEIGHTS

    every = chunks.sparkSession.createDataFrame([(x,) for x in LEVEL_WEIGHTS], "level string")
    return F.broadcast(every).join(chunks.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def parents(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, parent_content): the content of the article that a part of chunks(doc_id, chunk_index, kind, law, chapter, section, article,
    content) belongs to, the first of several; null for articles and above, and where there is none."""
    keys = ["law", "chapter", "section", "article"]
    inner = F.col("kind").isin("paragraph", "subparagraph", "item")
    first = chunks.where("kind = 'article'").groupBy(*keys).agg(F.min_by("content", F.struct("doc_id", "chunk_index")).alias("parent"))
    return chunks.join(first, keys, "left").select("doc_id", "chunk_index", F.when(inner, F.col("parent")).alias("parent_content"))
