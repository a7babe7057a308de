"""Splitters whose next cut depends on the last one.

A cut is found by a short walk over positions inside one text, so texts stay independent of one another and are walked in
Arrow batches where they lie; nothing is shuffled. Walks use positions, not copies, and take time linear in the text.
A null or blank text has no chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine, sentence ends, and the opening of an article.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", "、", " ", "")
SENTENCE_ENDS = "。\n！？"
ARTICLE_LINE = r"^第\s*[一二三四五六七八九十百千0-9]+(?:之[一二三四五六七八九十0-9]+)?\s*條"

#: Headings of articles, chapters and sections; ends of statements; connectives; marks a window may end after.
HEADING_LINE = r"^[ \t]*第\s*[一二三四五六七八九十百千0-9]+\s*[條章節]"
STATEMENT_ENDS = "。！？；"
CONNECTIVES = ("因此", "所以", "但是", "然而", "另外", "此外", "同時", "並且", "如果", "當", "除非", "只要", "只有", "不論", "無論", "根據", "依據", "按照", "依照")
PUNCTUATION = "。！？；，、"
WORD_ENDS = "。！？；：，、．·\n\r \t（）()「」\"【】[]《》<>"

#: Chunks in one Arrow batch that leaves a walk.
BATCH_ROWS = 1024


def walked(docs: DataFrame | None, walk: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """(doc_id, chunk_index, columns): walk gives the tuples of one text. Without docs the walk itself and its columns, for table
    functions."""
    if docs is None:
        return walk, columns
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, chunk_index int, {columns}").schema
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = ((key.as_py(), i, *chunk) for key, text in zip(batch.column(0), batch.column(1)) for i, chunk in enumerate(walk(text.as_py() or "")))
            while part := list(islice(rows, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), out)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def boundary_windows(docs: DataFrame, size: int = 500, tolerance: int = 50, overlap: int = 50, ends: str = SENTENCE_ENDS) -> DataFrame:
    """Windows of `size` characters that end after the last of `ends` in their final `tolerance` characters, if there is one.

    The next window starts `overlap` characters before that end. Blank windows are skipped; contents are trimmed, and
    start and end tell where the trimmed content lies.
    """
    if size < 1 or tolerance < 0 or not 0 <= overlap < size - tolerance:
        raise ValueError("need size >= 1, tolerance >= 0 and 0 <= overlap < size - tolerance")
    last_end = re.compile(f"[{re.escape(ends)}]")

    def walk(text: str):
        at, n = 0, len(text)
        while at < n:
            stop = min(n, at + size)
            found = [m.end() for m in last_end.finditer(text, at + size - tolerance + 1, min(stop + 1, n))]
            stop = found[-1] if found else stop
            inner = text[at:stop]
            if content := inner.strip():
                start = at + len(inner) - len(inner.lstrip())
                yield content, start, start + len(content)
            at = n if stop == n else stop - overlap

    return walked(docs, walk, "content string, start int, end int")


def recursive(docs: DataFrame, size: int = 500, overlap: int = 50, separators: tuple = SEPARATORS) -> DataFrame:
    """Pieces between separators packed into chunks of `size`; a piece too long is cut by the finer separators.

    Every chunk is one stretch of the text: a new one opens `overlap` characters before the end of the last, so it may be
    longer than size by the overlap and one piece. Where no separator occurs, windows of `size` are cut.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")

    def spans(text: str, low: int, high: int, finer: tuple):
        if high - low <= size:
            yield low, high
            return
        level = next((i for i, s in enumerate(finer) if s and text.find(s, low, high) >= 0), None)
        if level is None:
            yield from ((s, min(s + size, high)) for s in range(low, high, size - overlap) if not text[s : min(s + size, high)].isspace())
            return
        separator = finer[level]
        first = last = low  # the open chunk
        piece = low
        while piece <= high:
            cut = text.find(separator, piece, high)
            stop = high if cut < 0 else cut
            if first == last:
                first = last = piece
            if stop - first <= size:
                last = stop
            elif last > first:
                yield first, last
                first, last = (max(first, last - overlap) if overlap else piece), stop
            else:
                yield from spans(text, piece, stop, finer[level + 1 :])
                first = last = stop
            piece = high + 1 if cut < 0 else stop + len(separator)
        if last > first:
            yield first, last

    def walk(text: str):
        if text.strip():
            yield from ((text[a:b], a, b) for a, b in spans(text, 0, len(text), separators))

    return walked(docs, walk, "content string, start int, end int")


def structured_lines(docs: DataFrame, most: int = 1000, least: int = 200, tail: int = 2, opens: str = ARTICLE_LINE) -> DataFrame:
    """Trimmed lines packed into chunks of `most` characters; a line that `opens` starts a chunk once `least` are reached.

    A chunk starts with the last `tail` lines of the one before. A last chunk under `least` is added to the one before it.
    """
    heading = re.compile(opens)

    def walk(text: str):
        lines = [s for s in map(str.strip, text.split("\n")) if s]
        ends = [0, *accumulate(len(s) + 1 for s in lines)]
        length = lambda a, b: ends[b] - ends[a] - 1
        runs, first = [], 0
        for i, line in enumerate(lines):
            full = length(first, i) >= least if heading.match(line) else length(first, i) + 1 + len(line) > most
            if full and i > first:
                runs.append((first, i))
                first = max(first, i - tail)
        packs = [(a, b, None) for a, b in runs] + ([(first, len(lines), None)] if lines else [])
        if runs and length(first, len(lines)) < least:
            packs[-2:] = [(*runs[-1], first)]
        for a, b, more in packs:
            yield ("\n".join(lines[a:b] + (lines[more:] if more is not None else [])),)

    return walked(docs, walk, "content string")


def structure_density(docs: DataFrame, opens: str = HEADING_LINE) -> DataFrame:
    """(doc_id, lines, headings, density): headings among the lines that are not blank; null text has none, with density 0."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    heads = F.size(F.filter(lines, lambda s: s.rlike(opens)))
    counted = docs.select("doc_id", F.size(lines).alias("lines"), heads.alias("headings"))
    return counted.withColumn("density", F.round(F.col("headings") / F.greatest("lines", F.lit(1)), 6))


def structure_windows(docs: DataFrame, size: int = 500, overlap: float = 0.1, least: int = 100, ends: str = STATEMENT_ENDS, opens: str = HEADING_LINE) -> DataFrame:
    """Windows of at most `size` characters that end where the text does.

    A window ends before its last heading; else after its last statement end; else after the first punctuation that follows
    its last connective; else after its last mark; else at `size`. The next one starts a step later, but never beyond that
    end: size * (1 - overlap), times .8 where over a tenth of the lines are headings, 1.2 where under a twentieth are. A
    window under `least` takes in the next one up to twice that length. Together the windows cover the text; blank ones go.
    """
    if size < 1 or not 0 <= overlap < 1 or least < 0:
        raise ValueError("need size >= 1, 0 <= overlap < 1 and least >= 0")
    heading = re.compile(opens, re.MULTILINE)

    def last_of(text: str, marks: str, low: int, high: int) -> int:
        return max(text.rfind(c, low, high) for c in marks) + 1

    def cut(text: str, heads: list[int], at: int, stop: int) -> int:
        before = bisect_right(heads, stop) - 1
        if before >= 0 and heads[before] > at:
            return heads[before]
        if end := last_of(text, ends, at, stop):
            return end
        spot, word = max((text.rfind(w, at, stop), len(w)) for w in CONNECTIVES)
        if spot >= 0:
            after = [i for i in (text.find(c, spot + word, stop) for c in PUNCTUATION) if i >= 0]
            if after:
                return min(after) + 1
        return last_of(text, WORD_ENDS, at, stop) or stop

    def walk(text: str):
        n, at, held = len(text), 0, (0, 0)
        heads = [m.start() for m in heading.finditer(text)]
        density = len(heads) / max(1, sum(1 for s in text.split("\n") if s.strip()))
        step = max(1, int(size * (1 - overlap) * (0.8 if density > 0.1 else 1.2 if density < 0.05 else 1)))
        while at < n:
            stop = n if at + size >= n else cut(text, heads, at, at + size)
            if held[1] == 0 or held[1] - held[0] < least and stop - held[0] <= 2 * least:
                held = held[0], stop
            else:
                yield held
                held = at, stop
            at = n if stop == n else min(stop, at + step)
        yield held

    def filled(text: str):
        return ((text[a:b], a, b) for a, b in walk(text) if text[a:b].strip())

    return walked(docs, filled, "content string, start int, end int")


#: How lines open chapters, articles and items; groups are the number and what follows.
CHAPTER_OPENS = r"^(第\s*[一二三四五六七八九十百千0-9]+\s*章|總則|附則|罰則|附錄)[\u3000\s]*(.*)$"
ITEM_OPENS = r"^([（(][0-9０-９一二三四五六七八九十]+[）)]|(?:[一二三四五六七八九十]+|[0-9０-９]+)[、．.）)])\s*(.*)$"


def prefixed_structure(docs: DataFrame, size: int = 1000, overlap: int = 100, items: int = 3) -> DataFrame:
    """(content, prefix) of trimmed lines packed to `size`; an article opens a new chunk, and a chunk too long is cut by recursive().

    The pieces of a chunk that was cut bear where they stand: 【chapter】 and article, the first piece also the first
    `items` items, each on a line of its own before the piece. Chunks that were not cut have an empty prefix.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    chapter, article, item = (re.compile(p) for p in (CHAPTER_OPENS, ARTICLE_LINE, ITEM_OPENS))

    def pieces(text: str):
        """Stretches of at most `size` that end at the coarsest separator in their last half, else at size."""
        at = 0
        while at < len(text):
            stop = min(len(text), at + size)
            if stop < len(text):
                found = next((cut for cut in (text.rfind(s, at + size // 2, stop) + len(s) for s in SEPARATORS if s) if cut > at + size // 2), 0)
                stop = found or stop
            if text[at:stop].strip():
                yield text[at:stop]
            at = stop if stop == len(text) else max(at + 1, stop - overlap)

    def walk(text: str):
        held: list[str] = []
        place = {"chapter": "", "article": "", "items": []}

        def flush():
            body = "\n".join(held)
            if len(body) <= size:
                if body.strip():
                    yield body, ""
                return
            for k, piece in enumerate(pieces(body)):
                named = ([f"【{place['chapter']}】"] if place["chapter"] else []) + ([place["article"]] if place["article"] else []) + (place["items"][:items] if not k else [])
                prefix = "".join(f"{x}\n" for x in named)
                yield prefix + piece, prefix

        for line in map(str.strip, text.split("\n")):
            if not line:
                continue
            opens = article.match(line)
            if held and (opens or sum(map(len, held)) + len(held) + len(line) > size):
                yield from flush()
                held.clear()
            if chapter.match(line):
                place = {"chapter": line, "article": "", "items": []}
            elif opens:
                place = {"chapter": place["chapter"], "article": line, "items": []}
            elif item.match(line):
                place["items"].append(line)
            held.append(line)
        yield from flush()

    return walked(docs, walk, "content string, prefix string")


def by_sentence_length(docs: DataFrame, size: int = 600, other: int = 400, overlap: int = 40, share: float = 0.5, mark: str = "。") -> DataFrame:
    """Windows of `size` characters, or of `other` where the text that remains has sentences longer than share * size on average; the
    next starts `overlap` before the end. Contents are trimmed, blank ones skipped."""
    if size < 1 or other < 1 or not 0 <= overlap < min(size, other):
        raise ValueError("need size, other >= 1 and 0 <= overlap < both")

    def walk(text: str):
        n, at = len(text), 0
        marks = [i for i, c in enumerate(text) if c == mark]
        while at < n:
            left = len(marks) - bisect_right(marks, at - 1)
            stop = min(n, at + (other if (n - at) / max(1, left) > size * share else size))
            if content := text[at:stop].strip():
                yield (content, at, stop)
            at = n if stop == n else max(at + 1, stop - overlap)

    return walked(docs, walk, "content string, start int, end int")
