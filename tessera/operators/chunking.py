"""Splitting texts: documents to chunks with spans. Splits are array expressions inside a row; only their explode fans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Windows that are cut from one piece of a text.
RUN = 8


def windows(last: Column, step: Column, size: Column) -> Column:
    """array<struct<content, start>>: windows of `size` of the column text at 0, step, ... up to `last`.

    A character is found by walking from the start of its text, so cutting each window from the whole text is quadratic: RUN windows
    in a row are cut from a piece of their own.
    """
    def run(at: Column, end: Column) -> Column:
        cut = lambda piece: F.transform(F.sequence(at, F.least(end, at + step * (RUN - 1)), step), lambda s: F.struct(F.substr(piece, s - at + 1, size).alias("content"), s.alias("start")))
        return let(F.substr("text", at + 1, step * (RUN - 1) + size), cut)

    return let(last, lambda end: F.flatten(F.transform(F.sequence(F.lit(0), end, step * RUN), lambda at: run(at, end))))


def _spread(docs: DataFrame, last: Column, step: int, size: int) -> DataFrame:
    kept = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), F.filter(windows(last, F.lit(step), F.lit(size)), lambda w: F.trim(w["content"]) != "").alias("parts"))
    # of an inner explode the optimizer asks beforehand whether the array is null or empty, and cuts all windows for each answer
    each = kept.select("doc_id", "n", F.posexplode_outer("parts").alias("chunk_index", "p")).where("p IS NOT NULL")
    return each.select("doc_id", "chunk_index", "p.content", "p.start", F.least(F.col("p.start") + size, F.col("n")).alias("end"))


def fixed_ratio(docs: DataFrame, size: int = 500, ratio: float = 0.1) -> DataFrame:
    """Windows of `size` every size - int(size * ratio) characters to the very end; blank ones are skipped."""
    if not 0 <= ratio < 1 or size < 1:
        raise ValueError("size must be positive and 0 <= ratio < 1")
    return _spread(docs, F.length("text") - 1, size - int(size * ratio), size)


def sliding_stop(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` that overlap by `overlap` characters and stop with the one that reaches the end."""
    overlap = min(overlap, size - 1)
    return _spread(docs, F.greatest(F.lit(0), F.length("text") - overlap - 1), size - overlap, size)


def packed(pieces: Column, most: int, glue: str) -> Column:
    """Greedy packing of an array of strings, in order, into strings of at most `most` characters (longer pieces alone)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, s: Column) -> Column:
        over = (F.length(a["cur"]) + F.length(s) > most) & (a["cur"] != "")
        grown = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(glue), s))
        return F.struct(F.when(over, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"), F.when(over, s).otherwise(grown).alias("cur"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def sentence_packs(docs: DataFrame, most: int = 500, ends: str = "[.。！？!?]") -> DataFrame:
    """Whole sentences packed into chunks."""
    sentences = F.filter(F.transform(F.split("text", ends), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(packed(sentences, most, ". ")).alias("chunk_index", "content"))


def paragraph_packs(docs: DataFrame, most: int = 800) -> DataFrame:
    """Non-empty lines packed into chunks."""
    return docs.select("doc_id", F.posexplode(packed(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), most, "\n")).alias("chunk_index", "content"))


def hybrid(docs: DataFrame, primary: int = 600, secondary: int = 400, overlap: int = 40) -> DataFrame:
    """Lines packed to `primary`; a pack over 1.5 times that is cut into windows of `secondary`."""
    packs = paragraph_packs(docs, primary)
    long = packs.withColumnRenamed("content", "text").where(F.length("text") > primary * 1.5)
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(secondary - overlap))
    cut = long.select("doc_id", "chunk_index", F.posexplode(F.transform(starts, lambda s: F.substr("text", s + 1, F.lit(secondary)))).alias("sub_index", "content"))
    whole = packs.where(F.length("content") <= primary * 1.5).select("doc_id", "chunk_index", F.lit(0).alias("sub_index"), "content")
    return whole.unionByName(cut)


def statistics(chunks: DataFrame, by: list[str]) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.var_pop(n), 4).alias("var_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def grid(docs: DataFrame, sizes: tuple, ratios: tuple) -> DataFrame:
    """fixed_ratio chunks for every configuration; each document is read once and fanned out in its row."""
    configs = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(r).alias("ratio"), F.lit(s - int(s * r)).alias("step")) for s in sizes for r in ratios])
    each = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(configs).alias("g"))
    parts = F.filter(F.transform(windows(F.length("text") - 1, F.col("g.step"), F.col("g.size")), lambda w: w["content"]), lambda c: F.trim(c) != "")
    return each.select(F.col("g.size").alias("chunk_size"), F.col("g.ratio").alias("overlap_ratio"), "doc_id", F.posexplode(parts).alias("chunk_index", "content"))


def density(docs: DataFrame, pattern: str) -> DataFrame:
    """Share of a document's non-empty lines that match pattern, and the window step it asks for (of a base step)."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    share = F.round(F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda s: s.rlike(pattern))) / F.size(lines)).otherwise(0.0), 6)
    return docs.select("doc_id", share.alias("density"), F.when(share > 0.1, 0.8).when(share < 0.05, 1.2).otherwise(1.0).alias("step_factor"))


# --- more splitters -----------------------------------------------------------------------------------------------------------------
def overlap_windows(docs: DataFrame, window: int = 500, ratio: float = 0.1) -> DataFrame:
    """fixed_ratio() of texts that are not blank: windows every window - int(window * ratio) characters, each with its span."""
    return fixed_ratio(docs.where(F.trim("text") != ""), window, ratio)


def paragraphs_then_sentences(docs: DataFrame, most: int = 1000, least: int = 200, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, content, overlapped): paragraphs between blank lines; one over `most` characters is packed from its
    sentences (between 。), packs under `least` are dropped. overlap: behind each chunk longer than it stands a copy of the
    next one, if that is longer, too, with the last `overlap` characters of the chunk in place of its own first ones.
    """
    def packs(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
        kept = lambda a: F.when((F.length(a["cur"]) >= least) & (a["cur"] != ""), F.concat(a["done"], F.array(F.trim(a["cur"])))).otherwise(a["done"])

        def step(a: Column, s: Column) -> Column:
            fits = F.length(a["cur"]) + F.length(s) <= most
            grown = F.concat(a["cur"], s, F.lit("。"))
            return F.struct(F.when(fits, a["done"]).otherwise(kept(a)).alias("done"), F.when(fits, grown).otherwise(F.concat(s, F.lit("。"))).alias("cur"))

        return F.aggregate(F.split(p, "。"), start, step, kept)

    parts = F.flatten(F.transform(F.split("text", "\n\n"), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(packs(p))))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", parts.alias("parts"))
    if overlap <= 0:
        return rows.select("doc_id", F.posexplode("parts").alias("chunk_index", "content")).withColumn("overlapped", F.lit(False))
    after = lambda i: F.get("parts", i + 1)
    both = F.transform("parts", lambda c, i: F.when((F.length(c) > overlap) & (F.length(after(i)) > overlap), F.array(F.struct(c.alias("content"), F.lit(False).alias("overlapped")), F.struct(F.concat(F.right(c, F.lit(overlap)), F.substring(after(i), overlap + 1, 1 << 30)).alias("content"), F.lit(True).alias("overlapped")))).otherwise(F.array(F.struct(c.alias("content"), F.lit(False).alias("overlapped")))))
    return rows.select("doc_id", F.posexplode(F.flatten(both)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.content", "c.overlapped")


def split_oversize(chunks: DataFrame, most: int = 1000, ratio: float = 0.1, keys: tuple = ("doc_id", "chunk_index")) -> DataFrame:
    """(keys, part, content) of chunks(keys, content): those over `most` characters in pieces, others whole.

    Pieces are packed from paragraphs, else lines, else sentences (those packed to `most` first), joined by blank lines; each
    but the first starts with the last int(most * ratio) characters of the one before, if that was longer.
    """
    tail = int(most * ratio)
    blank = lambda a: F.filter(a, lambda s: F.trim(s) != "")

    def pieces(c: Column) -> Column:
        by_paragraph, by_line = blank(F.split(c, "\n\n")), blank(F.split(c, "\n"))
        return F.when(F.size(by_paragraph) > 1, by_paragraph).when(F.size(by_line) > 1, by_line).otherwise(packed(F.filter(F.split(c, "(?<=[。！？；;])"), lambda s: s != ""), most, ""))

    def pack(parts: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(a: Column, raw: Column) -> Column:
            s = F.trim(raw)
            over = (F.length(a["cur"]) + F.length(s) > most) & (a["cur"] != "")
            carried = F.trim(F.right(a["cur"], F.lit(tail))) if tail else F.lit("")
            opened = F.when((F.length(a["cur"]) > tail) & (carried != ""), F.concat(carried, F.lit("\n\n"), s)).otherwise(s)
            grown = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit("\n\n"), s))
            return F.struct(F.when(over, F.concat(a["done"], F.array(F.trim(a["cur"])))).otherwise(a["done"]).alias("done"), F.when(over, opened).otherwise(grown).alias("cur"))

        return F.aggregate(parts, start, step, lambda a: F.when(F.trim(a["cur"]) == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.trim(a["cur"])))))

    c = F.col("content")
    return chunks.select(*keys, F.posexplode(F.when(F.length(c) <= most, F.array(c)).otherwise(pack(pieces(c)))).alias("part", "content"))


def recovered_spans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, start, end) of chunks(doc_id, chunk_index, content) in docs(doc_id, text): each chunk is looked for from the end of
    the one before, else from the beginning of the text, else it is taken to follow the one before. Ends stay within the text.

    A text meets its own chunks in one row; the search runs over them in order.
    """
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<chunk_index:int,start:int,end:int>>").alias("out"))
    n = F.length("text")

    def step(a: Column, c: Column) -> Column:
        # each search is made once, and the one from the beginning only where the other finds nothing
        anywhere = let(F.instr("text", c["content"]) - 1, lambda p: F.when(p >= 0, p).otherwise(a["at"]))
        found = let(F.call_function("locate", c["content"], F.col("text"), a["at"] + 1) - 1, lambda p: F.when(p >= 0, p).otherwise(anywhere))

        def told(at: Column) -> Column:
            end = F.least(at + F.length(c["content"]), n)
            return F.struct(F.greatest(end, at).alias("at"), F.concat(a["out"], F.array(F.struct(c["chunk_index"].cast("int").alias("chunk_index"), at.alias("start"), end.alias("end")))).alias("out"))

        return let(found, told)

    return docs.join(listed, "doc_id").select("doc_id", F.inline(F.aggregate("chunks", start, step, lambda a: a["out"])))


def overlapping_spans(chunks: DataFrame, spans: DataFrame, least: float = 0.1) -> DataFrame:
    """(doc_id, chunk_index, span_id, share, rank): spans(span_id, doc_id, s, e) that cover more than `least` of a chunk(doc_id, chunk_index, start,
    end), those that cover most first."""
    from pyspark.sql import Window

    joined = chunks.select("doc_id", "chunk_index", "start", "end").join(spans, "doc_id").where((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    share = (F.least("end", "e") - F.greatest("start", "s")) / (F.col("end") - F.col("start"))
    order = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("share"), "span_id")
    return joined.withColumn("share", F.round(share, 6)).where(share > least).withColumn("rank", F.row_number().over(order)).select("doc_id", "chunk_index", "span_id", "share", "rank")


def overlap_rate(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, rate): how much longer the chunks of a text are together than the text, as a share of the text."""
    sums = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
    return sums.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", "n_chunks", F.round(F.greatest(F.lit(0.0), F.col("chars") / F.col("n") - 1), 6).alias("rate"))


def strategy(name: str, **parameters):
    """The splitter of a strategy's name, with the parameters that it takes; an unknown name means fixed size. chunk_size is
    the one size of every strategy, under whatever name its splitter has it."""
    from . import concept_spans, splitting

    size, overlap = parameters.get("chunk_size", 500), parameters.get("overlap_ratio", 0.1)
    steps = int(size * overlap)
    table = {
        "fixed_size": lambda d: fixed_ratio(d, size, overlap),
        "sliding_window": lambda d: sliding_stop(d, size, steps),
        "hierarchical": lambda d: splitting.structured_lines(d, size),
        "rcts_hierarchical": lambda d: splitting.prefixed_structure(d, size, steps),
        "recursive": lambda d: splitting.recursive(d, size, steps),
        "paragraph": lambda d: paragraphs_then_sentences(d, size, parameters.get("min_chunk_size", 0)),
        "semantic": lambda d: sentence_packs(d, size),
        "llm_semantic": lambda d: sentence_packs(d, size),
        "adaptive": lambda d: splitting.boundary_windows(d, size, min(50, size // 4), steps),
        "hybrid": lambda d: hybrid(d, size, max(1, size * 2 // 3), min(steps, size // 2)),
        "mean_sentence": lambda d: splitting.by_sentence_length(d, size, max(1, size * 2 // 3), steps),
        "semantic_integrity": lambda d: concept_spans.concept_windows(d, size),
    }
    return table.get(name, table["fixed_size"])


def batch(docs: DataFrame, strategies: tuple, sizes: tuple, ratios: tuple) -> DataFrame:
    """(strategy, chunk_size, overlap_ratio, doc_id, chunk_index, content) of every combination; one that a splitter refuses is left out."""
    out = None
    for name in strategies:
        for size in sizes:
            for ratio in ratios:
                try:
                    got = strategy(name, chunk_size=size, overlap_ratio=ratio)(docs)
                except ValueError:
                    continue
                got = got.select(F.lit(name).alias("strategy"), F.lit(size).alias("chunk_size"), F.lit(float(ratio)).alias("overlap_ratio"), "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")
                out = got if out is None else out.unionByName(got)
    return out
