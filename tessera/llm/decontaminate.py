"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of digits, ASCII letters (lower-cased) and bytes from 0x80 up. The automaton of the items' word sequences is
built on the driver and broadcast; items beyond WORDS_A_PASS words go to further passes, each with an automaton of
bounded size that is built when its pass begins and dropped after it. In a task, hashes of whole batches find the stretches of words that items know at all; only those stream
through the automaton, which tracks the longest match ending at each word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import ASCII_LOWER, buffer_of, pieces, prefix_hashes, span_hashes, words
from .common import shared, stored, table

WINDOW = 10
#: Words of items in one automaton; results do not depend on it.
WORDS_A_PASS = 100_000
#: A document with a larger share of hit words goes as a whole.
COVERAGE = 0.5

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton over word ids of many items; knows, for each state, the items and windows it ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.least = min((min(window, len(ws)) for _, ws in coded), default=0)
        #: state -> {window length: items}, for the windows that end in the state
        self.ends: dict[int, dict[int, set[str]]] = {}
        for name, ws in coded:
            state, k = 0, min(window, len(ws))
            for i, w in enumerate(ws, 1):
                state = self.next[state][w]
                if i >= k:
                    at = state
                    while self.size[self.link[at]] >= k:
                        at = self.link[at]
                    self.ends.setdefault(at, {}).setdefault(k, set()).add(name)
        # the nearest state up the links, itself included, that ends a window
        self.up = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            self.up[s] = s if s in self.ends else self.up[self.link[s]]
        words_ = sorted(self.ids)
        data = np.frombuffer(b"".join(words_), np.uint8)
        at = np.cumsum([0, *map(len, words_)])
        self.hashes = np.sort(span_hashes(prefix_hashes(data), at[:-1], at[1:])) if words_ else np.zeros(0, np.uint64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def stream(self, tokens: list[bytes], hit: np.ndarray, at: int, found: set[str]) -> None:
        """Marks in hit[at:] the words of tokens inside a window; adds the items to found."""
        state = matched = 0
        for i, word in enumerate(tokens):
            w = self.ids.get(word, -1)
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if w not in self.next[state]:
                continue
            state = self.next[state][w]
            matched += 1
            s = self.up[state]
            while s > 0:
                for k, names in self.ends[s].items():
                    if k <= matched:
                        hit[at + i + 1 - k : at + i + 1] = True
                        found |= names
                s = self.up[self.link[s]]


def _scan(auto: Automaton, data: np.ndarray, at: np.ndarray, hit: np.ndarray, tokens: tuple, found: dict[int, set[str]]) -> None:
    starts, ends, rows = tokens
    if not len(starts) or not auto.least:
        return
    h = span_hashes(prefix_hashes(data), starts, ends)
    slot = np.minimum(np.searchsorted(auto.hashes, h), len(auto.hashes) - 1)
    known = auto.hashes[slot] == h
    known_next = known.copy()
    fresh = rows[:-1][rows[:-1] < rows[1:]]  # a stretch ends with its row
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    begins[fresh] = known[fresh]
    known_next[:-1] = known[1:]
    known_next[-1] = False
    known_next[fresh[1:] - 1] = False
    first, last = np.flatnonzero(begins), np.flatnonzero(known & ~known_next) + 1
    long = last - first >= auto.least
    if not long.any():
        return
    row_of = np.searchsorted(rows, first[long], "right") - 1
    for f, e, r in zip(first[long].tolist(), last[long].tolist(), row_of.tolist()):
        auto.stream([data[s:t].tobytes() for s, t in zip(starts[f:e].tolist(), ends[f:e].tolist())], hit, f, found.setdefault(r, set()))


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def automata(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    """One automaton per WORDS_A_PASS words of items, one at a time. A longer item goes on in the next pass, from `window` - 1
    words back, so that each of its windows is in a pass."""
    most = max(WORDS_A_PASS, 2 * window)
    group, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        ws = item_words(r["text"])
        pieces_ = [ws[at : at + most] for at in range(0, max(1, len(ws) - window + 1), most - window + 1)]
        for piece in pieces_:
            if size and size + len(piece) > most:
                yield Automaton(group, window)
                group, size = [], 0
            group.append((r["i"], piece))
            size += len(piece)
    yield Automaton(group, window)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' columns but text, and n_words, hits (array<int>, start and end word of each hit span), items (array<string>).

    Null text has no words; texts are read whole, however long. Rows are judged one by one, whether their keys are null or
    repeat. Columns of docs named like the new ones are replaced. An empty benchmark hits nothing, empty docs give no rows.
    Items with one id count as one item. One automaton streams over docs lazily; with several, each pass writes its marks to
    the shared folder before the next automaton is built.
    """
    return _marked(docs, benchmark, window).drop("text")


def _marked(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """mark() with the text."""
    keep = [c for c in docs.columns if c not in ("text", "n_words", "hits", "items")]
    out = docs.select(*keep, "text").withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    given = None
    for auto in automata(benchmark, window):
        if given is not None:
            out = stored(_pass(out, given))
        given = shared(docs.sparkSession, auto)
        del auto
    return _pass(out, given)


def _pass(out: DataFrame, given: Callable) -> DataFrame:
    """out with the hits and items of one more automaton."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = out.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column, n = batch.column("text"), batch.num_rows
            data, at = buffer_of(column)
            n_words, hits, items = np.zeros(n, np.int64), batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for i, j in pieces(at):
                part = ASCII_LOWER[data[at[i] : at[j]]]
                here = at[i : j + 1] - at[i]
                tokens = words(part, here, WORD_BYTES)
                rows = tokens[2]
                n_words[i:j] = np.diff(rows)
                hit, found = np.zeros(len(tokens[0]), bool), {}
                _scan(given(), part, here, hit, tokens, found)
                for r, names in found.items():
                    if names:
                        mine = hit[rows[r] : rows[r + 1]]
                        for s, e in zip(hits[i + r][::2], hits[i + r][1::2]):
                            mine[s:e] = True
                        edges = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                        hits[i + r] = edges.tolist()
                        items[i + r] = sorted({*items[i + r], *names})
            cols = {f.name: batch.column(f.name) for f in arrow} | {"n_words": pa.array(n_words), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return out.mapInArrow(run, schema)


def _without(raw: bytes, tokens: tuple, spans: list[int]) -> bytes:
    """raw with a line break in the place of each span (start and end word, flat)."""
    keep, done = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        keep.append(raw[done : tokens[0][s]])
        done = tokens[1][e - 1]
    return b"\n".join([*keep, raw[done:]])


def _clean_in_rounds(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """clean() with several automata: a round marks by all of them, judges and cuts; what it cut goes to the next round."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]
    chars = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    todo = docs.toDF(*names).withColumns({"_asked": F.lit(-1).cast("long"), "_cut": F.lit(0).cast("long"), "_open": F.lit(False)})
    schema = todo.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, hits, n_words, asked, gone, size = (batch.column(c).to_pylist() for c in ("text", "hits", "n_words", "_asked", "_cut", chars or "_cut"))
            stay, still = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i, spans in enumerate(hits):
                asked[i] = n_words[i] if asked[i] < 0 else asked[i]
                if spans:
                    gone[i] += sum(spans[1::2]) - sum(spans[::2])
                    stay[i], still[i] = gone[i] <= coverage * asked[i], True
                    if stay[i]:
                        raw = texts[i].encode()
                        texts[i] = _without(raw, words(ASCII_LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), WORD_BYTES), spans).decode()
                        size[i] = len(texts[i])
            cols = {f.name: batch.column(f.name) for f in arrow if f.name in batch.schema.names} | ({chars: pa.array(size, pa.int64())} if chars else {})
            cols |= {"text": pa.array(texts, pa.string()), "_asked": pa.array(asked, pa.int64()), "_cut": pa.array(gone, pa.int64()), "_open": pa.array(still)}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow).filter(pa.array(stay))

    done = None
    while done is None or not todo.isEmpty():
        got = stored(_marked(todo, benchmark, window).mapInArrow(run, schema))
        settled = got.where("NOT _open")
        done = settled if done is None else done.unionByName(settled)
        todo = got.where("_open")
    return done.select(*names).toDF(*docs.columns)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without benchmark passages: hit spans are cut out of the text (a line break stays in their place), and a document
    of which more than `coverage` of the words are hit, by whatever items, goes as a whole. Cuts are repeated until nothing is
    hit. Untouched documents stay as they are, null texts too, and so do all other columns; n_chars, where there is one, follows
    the text. Rows are judged one by one, whether their keys are null or repeat. Empty docs give no rows. One automaton
    does all rounds of a document in its task; with several, each round is written to the shared folder, and only documents
    that it cut are read again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    built = automata(benchmark, window)
    only = next(built)
    if next(built, None) is not None:
        del only, built
        return _clean_in_rounds(docs, benchmark, window, coverage)
    schema, given = docs.schema, shared(docs.sparkSession, only)
    arrow = to_arrow_schema(schema)

    def cut(raw: bytes, auto: Automaton) -> bytes | None:
        total = 0
        n = None
        while True:
            data = ASCII_LOWER[np.frombuffer(raw, np.uint8)]
            here = np.array([0, len(data)])
            tokens = words(data, here, WORD_BYTES)
            n = len(tokens[0]) if n is None else n
            hit, found = np.zeros(len(tokens[0]), bool), {}
            _scan(auto, data, here, hit, tokens, found)
            if not hit.any():
                return raw
            total += int(hit.sum())
            if total > coverage * n:
                return None
            raw = _without(raw, tokens, np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist())

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            data, at = buffer_of(column)
            texts, stay = None, np.ones(batch.num_rows, bool)
            for i, j in pieces(at):
                part, here = ASCII_LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
                tokens = words(part, here, WORD_BYTES)
                hit, found = np.zeros(len(tokens[0]), bool), {}
                _scan(given(), part, here, hit, tokens, found)
                for r, names in found.items():
                    if names:
                        texts = column.to_pylist() if texts is None else texts
                        got = cut(texts[i + r].encode(), given())
                        stay[i + r] = got is not None
                        texts[i + r] = got.decode() if got is not None else None
            if texts is not None:
                cols = {f.name: batch.column(f.name) for f in arrow}
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    changed = pc.invert(pc.fill_null(pc.equal(cols["text"], column.cast(pa.string())), True))
                    cols["n_chars"] = pc.if_else(changed, pc.utf8_length(cols["text"]).cast(pa.int64()), cols["n_chars"].cast(pa.int64()))
                batch = pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow).filter(pa.array(stay))
            yield batch

    return docs.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mark() finds in all documents for all items of benchmark, one row a document."""
    got = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.col("hits")[i + 1] - F.col("hits")[i])
    n_hit = F.when(F.size("hits") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).cast("long")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
