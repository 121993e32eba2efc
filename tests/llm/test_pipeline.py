"""Every stage of the pipeline against a direct calculation on what its predecessor kept."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from conftest import SF

import corpus_pipeline
from seatrack.llm import fm, mixing
from seatrack.llm.queries import key_hash
from seatrack.llm.store import stage

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return dict(zip([name for name, _ in corpus_pipeline.STAGES], out, strict=True))


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages_return_documents(kept):
    columns = [x.columns for x, _ in kept.values()]
    assert all(c == columns[0] for c in columns)


def test_quality(spark, kept):
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(key_hash(5) != 0)
    scores = fm.classify(before, fm.train(before, labels)).collect()
    assert set(texts(after)) == {r["doc_id"] for r in scores if r["score"] >= 0.3}


def test_near_copies(kept):
    before, after = (texts(x) for x in kept["near_copies"])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in before.items()}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    want = {k for k in root if root[k] == k}
    assert len(set(after) ^ want) <= 2  # similarities are estimated close to 0.8


def test_passages(kept):
    before, after = (texts(x) for x in kept["passages"])
    holders = collections.defaultdict(set)
    for k, t in before.items():
        w = t.lower().split()
        for i in range(len(w) - 49):
            holders[tuple(w[i:i + 50])].add(k)
    again = collections.Counter(x for s in holders.values() if len(s) > 1 for x in s)
    # A passage of 50 words is left in one document at most.
    left = collections.Counter()
    for k, t in after.items():
        w = t.lower().split()
        left.update({tuple(w[i:i + 50]) for i in range(len(w) - 49)})
    assert not [p for p, n in left.items() if n > 1]
    changed = {k for k in before if after.get(k) != before[k]}
    near = {k for k in changed if k not in again}
    assert len(near) <= 0.05 * len(before)  # only documents that share shorter passages


def test_mixture(kept):
    before, after = kept["mixture"]
    plan = {r["doc_id"]: r for r in mixing.mix_plan(before).collect()}
    words = collections.Counter()
    for r in after.collect():
        words[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert words == {k: r["taken"] for k, r in plan.items() if r["taken"]}


def test_packed(kept):
    from tokenizers import Tokenizer

    before, after = kept["packed"]
    tok, want = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER)), collections.Counter()
    for r in before.collect():
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], a // 4096, zlib.crc32(ids[a:a + 4096].tobytes())) for a in range(0, len(ids), 4096))
    rows = after.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == want
    fill = collections.Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= 1.05 * -(-sum(fill.values()) // 4096) + 1
