"""Collocations, spelling variants and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from seatrack.llm import collocations, decontaminate, variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, n_words long, word string, _text string, _key long, h long, g long, item_id long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "w", "x", 1, 2, 3, 4) for k, t, lang in rows], SCHEMA)


# Collocations


def best_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= least}
    longest = collections.Counter()
    for (lang, g), c in f.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longest[lang, g[i:i + k]] = max(longest[lang, g[i:i + k]], c)
    out = collections.defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * longest[lang, g] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))  # noqa: E741
            out[lang].append((-score, -a, " ".join(g).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def told(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize(("least", "top", "span"), [(30, 2000, 1 << 21), (3, 40, 1500), (2, 7, 300)])
def test_collocations(spark, monkeypatch, least, top, span):
    rng = random.Random(least)
    words = ["new", "york", "city", "hall", "the", "of", "Zé", "a\x01", "a", "b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]))
            for i in range(120)] + [(None, None, None), (1, "", "en"), (7, "solo", "xx"), (8, "New York new york " * 400, "en")] * 2
    monkeypatch.setattr(collocations, "RUN", 50)
    monkeypatch.setattr(collocations, "SAMPLE", 16)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 4)
    got = collocations.collocations(table(spark, rows), least=least, top=top, span=span)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert told(got) == best_phrases(rows, least, top)


def test_collocations_of_the_table(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=10, span=4000)) == best_phrases(rows, 10, 2000)


def test_ranges_are_cut_inside_frequent_pairs(spark, monkeypatch):
    """One pair of words is most of the text, so it goes through many ranges; its counts are whole."""
    rng = random.Random(5)
    text = " ".join(f"x y {rng.choice('abcdefgh')} {rng.choice('abcdefgh')}" for _ in range(30_000))
    rows = [(i, text[i * 2000:(i + 1) * 2000], "en") for i in range(len(text) // 2000)]
    docs = table(spark, rows).repartition(6)
    counted = collocations._rows(docs, "lang", "text")
    counts = counted.mapInArrow(collocations._count_words, "g long, h long, c long").groupBy("g", "h").sum("c").withColumnRenamed("sum(c)", "c")
    words = collocations.Dictionary(collocations.sorted_arrays(counts.filter("h IS NOT NULL AND c >= 5"), ["h", "c", "g"], "d"))
    monkeypatch.setattr(collocations, "FLUSH", 2000)
    monkeypatch.setattr(collocations, "SAMPLE", 64)
    ranges = []
    monkeypatch.setattr(collocations, "_cut", lambda a, b, f=collocations._cut: ranges.append(len(a)) or f(a, b))
    stream = collocations.count_phrases(counted, words, 64 << 14, 5, 1 << 14)
    want = collections.Counter()
    for _, t, _ in rows:
        w = t.split()
        want.update(tuple(w[i:i + k]) for k in range(2, 5) for i in range(len(w) - k + 1))
    got = sorted(r["f"] for r in stream.collect())
    assert got == sorted(c for g, c in want.items() if c >= 5)
    assert ranges[0] >= 2


def test_collocations_without_phrases(spark):
    assert collocations.collocations(table(spark, []), least=2).count() == 0
    assert collocations.collocations(table(spark, [(1, None, "en"), (2, "a b", None)]), least=2).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    f = 9_000_000_000_000_000
    row = spark.createDataFrame([(f, f, f + 1)], "a long, l long, r long")
    got = row.select(collocations._score(row["a"], row["l"], row["r"]).alias("s"), collocations._score(row["a"], row["l"], row["l"]).alias("t")).first()
    assert got["s"] == 2_000_000 * f // (2 * f + 1) and got["t"] == 1_000_000


# Spelling variants


def counted(rows, spoil=31):
    n = collections.Counter()
    for k, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            if spoil and h % spoil == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 7:
                n[r] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def related(n):
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1:]].add(w)
            less = w[:i] + w[i + 1:]
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def forms(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [variants.LIMIT, 2])
def test_variants_of_the_table(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = related(counted([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert any(v[0] for v in want.values())
    assert forms(variants.spelling_variants(variants.word_counts(docs), limit=limit)) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abcÿ", min_size=0, max_size=6), max_size=60), st.booleans())
def test_composition_accepts_all_pairs_of_one_edit(some, double):
    lists = [sorted(some), sorted(some)[::2]] if double else [sorted(some)]
    words = [w for x in lists for w in x]
    codes = np.array([ord(c) for w in words for c in w], np.int64)
    acceptor = variants.Acceptor(codes, np.array([len(w) for w in words], np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists))
    got = [(int(g), lists[g][x], lists[g][y]) for own, xs, ys, _ in variants.compose(acceptor) for g, x, y in zip(own, xs, ys)]
    want = {(g, *sorted((a, b), key=lambda w: (len(w), w))) for g, x in enumerate(lists) for a in x for b in x if a < b and one_edit(a, b)}
    assert len(got) == len(want) and {(g, *sorted((a, b), key=lambda w: (len(w), w))) for g, a, b in got} == want


def test_acceptor_is_minimal():
    words = ["abing", "ading", "ing", "xing"]
    a = variants.Acceptor(np.array([ord(c) for w in words for c in w]), np.array([5, 5, 3, 4]), np.zeros(4, np.int64), 1)
    # Start, after a, one state before "ing" for ab, ad and x, then its three.
    assert len(a.final) == 6


def test_a_hot_partition_is_parted_again(spark):
    words = [f"common{a}{b}tail" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"] + ["commonaatai", "ommonaatail"]
    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    parts = variants.partitions(vocabulary, limit=20)
    sizes = {r["key"]: (r["count"], r["places"]) for r in parts.groupBy("key").agg(variants.F.count("*").alias("count"), variants.F.min(variants.F.col("hi") - variants.F.col("lo")).alias("places")).collect()}
    assert all(n <= 20 or places == 1 for n, places in sizes.values())
    got = {frozenset((r["a"], r["b"])) for r in variants.near_pairs(vocabulary, limit=20).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert variants.near_pairs(vocabulary, limit=20).count() == len(got)


def test_variants_edge_cases(spark):
    long = "q" * 3000
    rows = [(1, "Strasse strasse STRASSE straßen straßen", "de"), (2, None, None), (3, "", "x"), (None, "überall überall " + long, None), (None, long + "e " + long, None),
            (None, long + "e", None), (5, "naïveté×naïveté÷naïveté", "fr"), (5, "naïveté×naïveté÷naïveté", "fr"), (6, "퟿中文abcdefg中abcdefg", "zh")]
    docs = table(spark, rows)
    assert forms(variants.spelling_variants(variants.word_counts(docs))) == related(counted([x[:2] for x in rows]))
    assert forms(variants.spelling_variants(variants.word_counts(docs, spoil=None))) == related(counted([x[:2] for x in rows], None))
    empty = variants.spelling_variants(variants.word_counts(table(spark, [])))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_roots_follow_forms(spark):
    chain = [("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000), ("abcdefghijk", 10000), ("zzzzzzz", 3)]
    got = forms(variants.spelling_variants(spark.createDataFrame(chain, "word string, n long")))
    assert {got[w][1] for w, _ in chain[:-1]} == {"abcdefghijk"} and got["zzzzzzz"] == (None, "zzzzzzz", 3, 0, None)


# Decontamination


def hits(docs, items):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for key, text in items:
        w = plain(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i:i + 10])].add("" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found = plain(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def marks(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [decontaminate.LIMIT, 60])
def test_decontamination(spark, limit):
    rng = random.Random(1)
    words = ["the", "of", "Über", "n°1", "x", "中文", "12"]
    items = [(i % 17, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randrange(25)))) for i in range(40)]
    items += [(99, "lone"), (None, "two words"), (5, None), (6, ""), (7, "?!"), items[3]]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", ". "]) for _ in range(rng.randrange(80))) + (rng.choice(items)[1] or "") * (i % 3 == 0) if i % 7 else
             f"Before {rng.choice(items)[1] or ''} after") for i in range(60)]
    docs += [(None, "Two  WORDS!"), (4, None), (4, ""), (4, " .,"), (8, "alone lone"), (8, "alone lone"), (9, "filler " * 3000 + items[0][1] + " filler" * 700)]
    bench = spark.createDataFrame([(k, t, 1, "u") for k, t in items], "item_id long, text string, doc_id long, _item string")
    models = decontaminate.automata(bench, limit=limit)
    assert (len(models) > 1) == (limit == 60)
    table_ = table(spark, [(k, t, None) for k, t in docs])
    assert marks(decontaminate.contamination(table_, models)) == hits(docs, items)
    texts = collections.defaultdict(set)
    for k, t in docs:
        texts[k].add(t)
    spans = decontaminate.contaminated_spans(table_, models).collect()
    assert sum(r["n_words"] for r in spans) == sum(x[2] for x in hits(docs, items))
    assert all(any(t and t[r["start"]:r["end"]] == r["passage"] for t in texts[r["doc_id"]]) for r in spans)
    clean = decontaminate.clean_documents(table_, models)
    assert clean.columns == table_.columns and clean.count() == sum(not x[5] for x in hits(docs, items))
    assert decontaminate.clean_documents(table_, models, share=1.0).count() == len(docs)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    docs = table(spark, [(1, "a b c", None), (2, None, None)])
    assert [r["contaminated"] for r in decontaminate.contamination(docs, decontaminate.automata(bench)).collect()] == [False, False]
    some = decontaminate.automata(spark.createDataFrame([("q", "a b")], "item_id string, text string"))
    assert decontaminate.contamination(table(spark, []), some).count() == 0
    assert marks(decontaminate.contamination(docs, some)) == hits([(1, "a b c"), (2, None)], [("q", "a b")])


@pytest.mark.parametrize("kind", ["int", "long", "smallint"])
def test_phrase_fingerprints_of_integer_keys(spark, kind):
    from seatrack.llm import phrases

    docs = spark.createDataFrame([(1, "abc abd abe"), (2, "xyz " * 30), (None, None), (3, "")], f"doc_id {kind}, text string")
    rows = phrases.phrase_fingerprints(docs, buckets=2)
    assert rows.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in rows.collect()) == [(False, 1, 11), (False, 2, 120), (False, 3, 0), (True, 0, 0)]
