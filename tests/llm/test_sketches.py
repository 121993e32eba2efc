"""Sketches of paragraphs: none that is similar to another goes, and the contents of the others are not sent."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from seatrack.llm import substring


def _rows(sets):
    s = np.concatenate([np.array(x, np.uint64) for x in sets])
    n = np.array([len(x) for x in sets])
    sketch = substring._sketches(s, n.cumsum() - n, n)
    held = [[int(np.bitwise_or.reduce(x))] if k < substring._MANY else x.tolist() for x, k in zip(sketch, n, strict=True)]
    lists = pa.array([[v - (1 << 64) if v >> 63 else v for v in x] for x in held], pa.list_(pa.int64()))
    return pa.table({"band": np.zeros(len(sets), np.int64), "digest": np.arange(len(sets)), "n": n.astype(np.int32), "sketch": lists})


def test_similar_sets_stay_and_others_go():
    draw, sets = random.Random(5), []
    for _ in range(150):
        a = [draw.getrandbits(64) for _ in range(draw.choice([4, 5, 9, 30, 47, 48, 60, 300, 2000]))]
        b = [draw.getrandbits(64) if draw.random() < 0.12 else x for x in a]
        sets += [a, b[:len(b) - draw.randint(0, len(b) // 8)] + b[:draw.randint(0, 2)]]
    similar = [len({*a} & {*b}) >= substring.SIMILAR * len({*a} | {*b}) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 30 < sum(similar) < 140
    for pair, whole in zip(zip(sets[::2], sets[1::2], strict=True), similar, strict=True):
        (found,) = substring._candidates(_rows(pair), np.array([2]))
        assert not whole or len(found) == 2
    apart = [[draw.getrandbits(64) for _ in range(draw.choice([9, 30, 60, 300]))] for _ in range(200)]
    (found,) = substring._candidates(_rows(apart), np.array([200]))
    assert len(found) < 10


def _sent(monkeypatch):
    """Rows of every table that is written."""
    sent, write = {}, substring.stage

    def watch(rows, label):
        out = write(rows, label)
        sent[label] = out.count()
        return out

    monkeypatch.setattr(substring, "stage", watch)
    return sent


def _texts(draw):
    word = lambda n: "".join(draw.choices("abcdefghijkl", k=n))
    phrase = " ".join(word(5) for _ in range(12))
    rows = [(k, " ".join(word(6) for _ in range(15)) + f" {phrase} " + " ".join(word(6) for _ in range(15))) for k in range(60)]
    line = [word(6) for _ in range(40)]
    return [*rows, (60, " ".join(line)), (61, " ".join([*line[:-1], "another"]))]


def test_contents_of_paragraphs_that_meet_by_chance_are_not_sent(spark, monkeypatch):
    sent = _sent(monkeypatch)
    found = {r._node: r._root for r in substring.similar_paragraphs(spark.createDataFrame(_texts(random.Random(3)), "doc_id long, text string")).collect()}
    assert sent["met"] > 60 and 2 <= sent["band-contents"] <= 8
    assert len(found) >= 2 and len(set(found.values())) < len(found)


def test_stage_of_the_pipeline_sends_no_more(spark, monkeypatch):
    sent, rows = _sent(monkeypatch), _texts(random.Random(3))
    left = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert 2 <= sent["band-contents"] <= 8 and sent["extra"] >= 1
    assert left[60] == rows[60][1] and left.get(61) != rows[61][1]
