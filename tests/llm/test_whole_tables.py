"""Queries over whole tables, row by row against plain programs that follow their contracts by definition."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from tessera.llm import queries

DATA = "/root/testdata/sf0.01"


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]


def least_reachable(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each one reaches over a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.array([label[np.flatnonzero(mine)].min(initial=label[i]) for i, mine in enumerate(linked)])
        if (new == label).all():
            return label
        label = new


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], (x or "" for x in t["text"]))))


def test_every_repeated_byte(spark, texts):
    first: dict[bytes, tuple] = {}
    want = {}
    for key, text in texts.items():
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if first.setdefault(data[s : s + 100], (key, s)) != (key, s):
                gone[s : s + 100] = True
        runs = int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum())
        want[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    assert any(w[1] for w in want.values())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op7_suffix_dedup")} == want


def test_every_fingerprint_and_component(spark, texts):
    prints = []
    for text in texts.values():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = np.array([xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles], np.uint64)
        prints.append(sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes)))
    values, keys = np.array(prints, np.uint64), list(texts)
    least = least_reachable(np.bitwise_count(values[:, None] ^ values[None]) <= 3)
    want = {k: (f"{p:016x}", keys[c]) for k, p, c in zip(keys, prints, least)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op5_simhash_dedup")} == want


def test_every_link_of_hot_vectors(spark, tmp_path):
    """One vector in very many rows, one cloud of near copies, pairs from just over the threshold on, and vectors alone."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((1200, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((200, 32))
    side -= (side * base[:200]).sum(1, keepdims=True) * base[:200]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.linspace(0.905, 0.999, 200)[:, None]
    v = np.concatenate([base, cosine * base[:200] + np.sqrt(1 - cosine**2) * side, np.repeat(base[300:301], 900, 0), base[301:302] + 0.02 * rng.standard_normal((500, 32))])
    v = v[rng.permutation(len(v))].astype(np.float32).astype(float)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.9
    least = least_reachable(linked)
    want = {i: (int(n) - 1, int(c), bool(c == i)) for i, (n, c) in enumerate(zip(linked.sum(axis=1), least))}
    got = queries.QUERIES["op1_near_embeddings"](spark, str(tmp_path)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want
