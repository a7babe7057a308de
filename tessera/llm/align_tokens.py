"""Cross-tokenizer alignment: two tokenisations of one text, cut into groups where both have a token border.

Texts are tokenised in Arrow batches, which gives the ids of both tokenizers and the byte offsets at which their tokens end. The common
borders are the bytes that both sides mark as an end; what stands before a token of a group is told by sums, so groups come out
in linear time, however long a text is, for many texts at once. What ends together is linked; how many links hold a pair of
ids is counted over the corpus.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, shared, stored, table

#: The folder of vocabulary files, and the two that op12 uses.
FOLDER, BYTE_BPE, PIECE_BPE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the pattern at which byte-level BPE of this kind cuts texts before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from here on overflow the stack of tiktoken's pattern search; such texts take the slower library.
LONG_BLANK = re.compile(r"\s{1000}")
#: Bytes of text that are tokenised before their tokens are given out.
PIECE = 1 << 20
#: Rows of a table of pairs (two numbers each) that may be broadcast, about 60 MB.
PAIRS = 1_000_000
#: What follows an id in the text of a group: another id of its side, the other side, or nothing.
MARKS = (",", "|", "")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible Latin-1, else the next free one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Byte-level BPE from a tokenizers JSON file. Ids in the order of the merges are ranks, which tiktoken runs several times faster."""

    def __init__(self, raw: bytes):
        self.raw, self.fast = raw, None

    def __getstate__(self):
        return {"raw": self.raw, "fast": None}

    def build(self) -> None:
        import tiktoken

        told, alphabet = json.loads(self.raw), byte_alphabet()
        vocabulary, merges = told["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        made = [vocabulary[a + b] for a, b in merges]
        plain = told.get("normalizer") is None and (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        special = {x["id"] for x in told.get("added_tokens", [])}
        self.fast = False
        if plain and made == sorted(made) and len(self.bytes) - len(special & set(range(len(self.bytes)))) == 256 + len(merges):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in special}, special_tokens={})
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)

    @cached_property
    def slow(self):
        """The library that runs any such file; built when a text or the vocabulary needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.raw.decode())
        made.encode_special_tokens = True
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        texts = [f" {t}" for t in texts]
        if not self.fast:
            return [np.array(e.ids, np.int32) for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]
        slow = lambda t: self.slow.encode(t, add_special_tokens=False).ids
        return [np.array(slow(t) if len(t) > 1000 and LONG_BLANK.search(t) else self.fast.encode_ordinary(t), np.int32) for t in texts]


class Pieces:
    """BPE with byte fallback from a sentencepiece file, which puts the space before a text itself."""

    def __init__(self, raw: bytes):
        self.raw, self.fast = raw, None

    def __getstate__(self):
        return {"raw": self.raw, "fast": None}

    def build(self) -> None:
        import sentencepiece

        self.fast = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        ids = range(self.fast.get_piece_size())
        self.bytes = [bytes([int(self.fast.id_to_piece(i)[3:5], 16)]) if self.fast.is_byte(i) else self.fast.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.fast.encode(texts, num_threads=1)]


def encoder(path: str) -> ByteLevel | Pieces:
    """The tokenizer of a file that the driver reads; its bytes travel to the tasks, which need no file."""
    with open(path, "rb") as f:
        raw = f.read()
    return Pieces(raw) if path.endswith(".model") else ByteLevel(raw)


def _encoding(get, key: str):
    """What a task of tokenised() does with its batches of (key, text). get: gives both encoders."""

    def listed(rows: list[np.ndarray]) -> pa.Array:
        at = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))

    def run(batches):
        both = get()
        for e in both:
            if e.fast is None:
                e.build()
        none = np.zeros(0, np.int32)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PIECE, "right")))
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                found = [e.encode(texts) for e in both]
                whole = lambda e, t, ids: b"".join([e.bytes[x] for x in ids.tolist()]) == b" " + t.encode()
                fine = [bool(t) and all(whole(e, t, ids[k]) for e, ids in zip(both, found)) for k, t in enumerate(texts)]
                sides = [[x if ok else none for x, ok in zip(ids, fine)] for ids in found]
                columns = []
                for e, ids in zip(both, sides):
                    columns += [listed(ids), listed([np.cumsum(e.sizes[x], dtype=np.int32) for x in ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=[key, "a", "a_ends", "b", "b_ends"])
                i = j

    return run


def tokenised(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a, a_ends, b, b_ends): ids of both tokenizers and the byte offsets in space + text at which their tokens end.

    Texts that are null or empty, or that the tokens of either side do not give back byte for byte, have no tokens.
    """
    run = _encoding(shared(docs.sparkSession, (a, b)), key)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>")


def _written(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes): the ids in decimal, each with its mark of MARKS behind it, one after the other, and the bytes that each takes."""
    known, at = np.unique(ids, return_inverse=True)
    told = [f"{i}{m}".encode() for i in known.tolist() for m in MARKS]
    wide, size = max(map(len, told), default=1), np.array([len(t) for t in told], np.int64)
    table = np.frombuffer(b"".join(t.ljust(wide) for t in told), np.uint8).reshape(-1, wide)
    code = at.ravel() * len(MARKS) + after
    sizes = size[code]
    return table[code][np.arange(wide) < sizes[:, None]], sizes


def _groups(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(groups, links, last): of tokens whose ends rise, all texts of a piece on one line; last tells the a tokens that end a group."""
    seen = np.zeros(int(max(a_ends.max(initial=0), b_ends.max(initial=0))) + 1, np.uint8)
    seen[a_ends] = 1
    seen[b_ends] |= 2
    last_a, last_b = seen[a_ends] == 3, seen[b_ends] == 3
    at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    # the a tokens of a group stand after the b tokens of the groups before it, its b tokens after its a tokens
    place_a = np.arange(len(a)) + np.r_[0, at_b + 1][np.cumsum(last_a) - last_a]
    place_b = np.arange(len(b)) + np.r_[at_a + 1, len(a)][np.cumsum(last_b) - last_b]
    ids, after = np.zeros(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    after[place_a[at_a]], after[place_b[at_b]] = 1, 2
    data, sizes = _written(ids, after)
    cut = np.r_[0, np.cumsum(sizes)[place_b[at_b]]].astype(np.int32)
    groups = pa.StringArray.from_buffers(len(at_b), pa.py_buffer(cut), pa.py_buffer(data))
    return groups, pa.array(a[at_a].astype(np.int64) << 32 | b[at_b]), last_a


def _aligning(keep: list[str]):
    """What a task of aligned() does with its batches of tokens."""
    sides = ["a", "a_ends", "b", "b_ends"]

    def run(batches):
        for batch in batches:
            size = {c: pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in ("a", "b")}
            load = np.cumsum(size["a"] + size["b"])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + PIECE, "right")))
                part = batch.slice(i, j - i)
                a, a_ends, b, b_ends = (part.column(c).flatten().to_numpy() for c in sides)
                at_a, at_b = (np.r_[0, np.cumsum(size[c][i:j])] for c in ("a", "b"))
                full = lambda ends, at: np.where(at[1:] > at[:-1], ends[at[1:] - 1] if len(ends) else 0, 0)
                base = np.r_[0, np.cumsum(np.maximum(full(a_ends, at_a), full(b_ends, at_b)) + 1)][:-1]
                groups, links, last = _groups(a, a_ends + np.repeat(base, np.diff(at_a)), b, b_ends + np.repeat(base, np.diff(at_b)))
                rows = pa.array(np.r_[0, np.cumsum(last)][at_a].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(rows, groups), pa.ListArray.from_arrays(rows, links)], names=[*keep, "groups", "links"])
                i = j

    return run


def aligned(tokens: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """tokens with `groups`, array<string> of the groups as `a1,a2|b1`, and `links`, array<long> of a * 2^32 + b of the tokens that
    end together, one a group, as each border ends one token of either side. No tokens: none.

    Rows are worked on where they lie, about PIECE tokens at once. keep: the columns of tokens that are given back, else all.
    """
    keep, kinds = tokens.columns if keep is None else keep, dict(tokens.dtypes)
    return tokens.mapInArrow(_aligning(keep), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "groups array<string>, links array<bigint>"]))


def aligned_texts(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, groups, links) of docs(key, text): tokenised() and aligned(), one after the other for about PIECE bytes of text in
    the same worker, so a task holds the tokens of one piece and they never leave it."""
    encode, align = _encoding(shared(docs.sparkSession, (a, b)), key), _aligning([key, "n_a", "n_b"])

    def run(batches):
        for part in encode(batches):
            counts = [pc.list_value_length(part.column(c)).cast(pa.int64()) for c in ("a", "b")]
            yield from align([pa.RecordBatch.from_arrays([*part.columns, *counts], names=[*part.schema.names, "n_a", "n_b"])])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_a bigint, n_b bigint, groups array<string>, links array<bigint>")


def pair_counts(rows: DataFrame, links: str = "links") -> DataFrame:
    """(pair, n, best): how many links of all rows hold the pair of ids, and whether no pair of its b holds more. Stored.

    There are fewer pairs than products of two vocabularies, and a b has at most a vocabulary of partners.
    """
    pairs = stored(rows.select(F.explode(links).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stored(pairs.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(rows: DataFrame, key: str, links: str = "links") -> DataFrame:
    """(key, n_best, count_sum) of rows(key, links), where no key repeats: links whose pair is its b's most frequent one, and the sum of
    the counts of their pairs. Rows without links are left out. Pairs are broadcast if a count finds few enough; else the links
    of frequent pairs meet a broadcast of those pairs, and the others shuffle."""
    counts = pair_counts(rows, links)
    each = rows.select(key, F.explode(links).alias("pair"))
    met = each.join(F.broadcast(counts), "pair") if counts.count() <= PAIRS else join_hot(each, counts.withColumn("count", F.col("n")), "pair", "n").withColumnRenamed("count", "n")
    return met.groupBy(key).agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))


def op12(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    """Per document its tokens of both sides, groups and links, and how its links stand in the corpus; see aligned() and scored().
    Repeated doc_ids are documents of their own: rows are told apart by a number of the stored table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda c: F.size(c).cast("long")
    found = aligned_texts(docs, encoder(f"{folder}/{BYTE_BPE}"), encoder(f"{folder}/{PIECE_BPE}"))
    digest = F.when(F.size("groups") > 0, F.sha2(F.array_join("groups", ";").cast("binary"), 256)).otherwise("")
    rows = found.select("doc_id", "n_a", "n_b", n("groups").alias("n_groups"), n("links").alias("n_links"), digest.alias("groups_sha256"), "links")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(scored(rows, "_row"), "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
