"""Lines that recur in documents of a host: against brute force, with lines that go and documents that are depleted."""

from __future__ import annotations

import collections
import random
import re

import pytest

from seatrack.llm import quality

GAP = "[\x20\x09-\x0D]+"


def normal(line):
    return " ".join(w for w in re.split(GAP, line) if w).lower()


def words(text):
    return [w for w in re.split(GAP, text) if w]


def verdicts(rows, share, least, depleted=0.5, min_words=20):
    docs, held = collections.defaultdict(set), collections.defaultdict(set)
    for k, t, host in rows:
        docs[host].add((k, t or ""))
        for line in (t or "").split("\n"):
            if normal(line):
                held[host, normal(line)].add((k, t or ""))
    over = {x for x, d in held.items() if len(d) > max(least, share * len(docs[x[0]]))}
    out, texts = [], []
    for k, t, host in rows:
        lines = (t or "").split("\n")
        lost = sum(len(words(x)) for x in lines if (host, normal(x)) in over)
        w = words(t or "")
        windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((k, len(w), lost, failed, not failed and len(w) - lost >= min_words and lost <= depleted * len(w)))
        texts.append((k, "\n".join(x for x in lines if (host, normal(x)) not in over)))
    return over, sorted(out, key=str), sorted(texts, key=str)


@pytest.mark.parametrize(("share", "least"), [(quality.SHARE, quality.LEAST), (0.2, 1)])
def test_recurring_lines(spark, share, least):
    rng = random.Random(4)
    pool = [f"Line {i} of a\tlarge  stock" for i in range(40)]
    boiler = ["All Rights  reserved by the\x0bhost of these many pages", "cookie notice"]
    rows = []
    for i in range(90):
        lines = [rng.choice(pool) for _ in range(rng.randrange(9))] + [f"own {i} " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(12))]
        lines += rng.sample(boiler, rng.randrange(3))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["big", "big", "small", None])))
    # A short host whose page text is mostly boilerplate, exact copies under other keys, and repeated rows.
    rows += [(100 + i, f"{boiler[0]}\n{boiler[0].upper()}\nnews {i} of {i * 7} today and {i * 3} more words to reach enough of them", "tiny") for i in range(5)]
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(6)] + [rows[1]] * 4 + [(300, None, "big"), (301, "", None), (302, "\n \n", "tiny")]
    docs = spark.createDataFrame([(k, t, h, 1, "x", 2) for k, t, h in rows], "doc_id long, text string, source string, n_words long, _key string, _hash long")
    over, want, texts = verdicts(rows, share, least)
    assert {h for h, _ in over} >= {"big", "tiny"} and any(not failed and not kept for _, _, _, failed, kept in want)
    got = quality.quality_rules(docs, share=share, least=least).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_frequent_words"], r["base_failed"], r["kept"]) for r in got), key=str) == want
    assert sorted(((r["doc_id"], r["text"]) for r in quality.without_frequent_lines(docs, share=share, least=least).collect()), key=str) == texts
