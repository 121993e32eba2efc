"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seatrack.llm import crf, fm, mixing, ngrams, packing, phrases, quality, simhash, store, substring, tokencount

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, bin int, digest string, _text string, position double"
LONG = " ".join(f"word{i % 9973} et{i % 7}" for i in range(40_000))
TEXTS = [(1, "one two three. Four five six\nseven eight"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x"), (6, "x"), (7, "😀 <|endoftext|> ▁a  bé"),
         (8, "one two three. Four five six\nseven eight"), (None, "lost and found")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k in (2, 5) else "en", None if k == 3 else "s", 1, 1, "i", 1, "d", "t", 0.5) for k, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted(((r[names[0]] is None, *[r[n] for n in names]) for r in df.collect()), key=str)


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert quality.quality_rules(docs).count() == len(TEXTS)
    assert all(got[k]["n_words"] == 0 and not got[k]["kept"] for k in (2, 3, 4))
    assert got[5]["n_words"] == 80_000 and got[1]["n_dup_lines"] == 0
    assert quality.quality_rules(none).count() == 0
    assert quality.without_frequent_lines(docs).filter("doc_id = 1").first()["text"] == TEXTS[0][1]


def test_mixing(docs, none):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["taken"] == 0 and r["first_position"] is None for r in rows if r["doc_id"] in (2, 3, 4))
    assert sum(r["taken"] for r in rows) == round(1.5 * sum(r["size"] for r in rows))
    assert mixing.mix_plan(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} >= {1, 5, 8}
    assert mixing.mixed_documents(none).count() == 0


def test_token_counts(spark, docs, none):
    model = P.path("piece_bpe_32k.model")
    cache = store.shared_path(spark, "cache")
    first = rows_of(tokencount.token_counts(docs, model, cache), "doc_id", "n_bytes", "n_tokens")
    size = spark.read.parquet(cache).count()
    assert rows_of(tokencount.token_counts(docs, model, cache), "doc_id", "n_bytes", "n_tokens") == first
    assert spark.read.parquet(cache).count() == size == len({t or "" for _, t in TEXTS})
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert first == sorted(((k is None, k, len((t or "").encode()), len(sp.encode(t or ""))) for k, t in TEXTS), key=str)
    assert tokencount.token_counts(none, model, store.shared_path(spark, "cache")).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "a"), (5, 0, "b"), (6, None, "c"), (None, 1, "d"), (99, 1, "e")], "doc_id long, quality int, _order string")
    model = fm.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in fm.classify(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] > scores[5]
    assert scores[2] == scores[3]
    assert fm.classify(none, model).count() == 0
    untaught = fm.train(docs, labels.limit(0))
    assert {r["score"] for r in fm.classify(docs, untaught).collect()} == {0.5}
    assert fm.accepted(docs, untaught).count() == len(TEXTS) and fm.accepted(none, model).count() == 0
    assert fm.accepted(docs, model, least=0.0).columns == docs.columns


def test_language(docs, none):
    model = crf.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf.predict(docs, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (2, 3, 4))
    assert got[1] == ("en", 1.0) and got[None][0] == "en"
    assert crf.train(none) is None
    assert {r["lang_pred"] for r in crf.predict(docs, None).collect()} == {"und"}
    assert crf.predict(none, model).count() == 0


def test_simhash(docs, none):
    got = {r["doc_id"]: r for r in simhash.simhash(docs).collect()}
    assert all(got[k]["fingerprint"] == "0" * 16 and got[k]["component_id"] == 2 for k in (2, 3, 4))
    assert got[8]["component_id"] == 1 and got[6]["component_id"] == 6 and got[None]["component_id"] is None
    assert simhash.simhash(docs).count() == len(TEXTS) and simhash.simhash(none).count() == 0
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 6, 7, None], key=str)
    assert simhash.without_near_copies(none).count() == 0


def test_passages(spark, docs, none):
    assert substring.repeated_passages(docs).count() == 0  # eight words are no passage
    found = substring.repeated_passages(docs, min_words=5).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"], r["keep_doc_id"]) for r in found] == [(8, 0, 8, 1)]
    left = {r["doc_id"]: r["text"] for r in substring.without_passages(docs, min_words=5).collect()}
    assert 8 not in left and left[1] == TEXTS[0][1] and left[5] == LONG
    assert substring.without_passages(docs).count() == len(TEXTS)
    assert substring.repeated_passages(none).count() == 0 and substring.without_passages(none).count() == 0


def test_packing(docs, none):
    path = P.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == len(TEXTS)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert all(r["start"] == 4096 * r["piece"] for r in rows) and max(r["piece"] for r in rows) > 10
    by_bin: dict = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_bin.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 4096
    assert packing.pack(none, path).count() == 0


def test_phrases(docs, none):
    rows = phrases.phrase_fingerprints(docs, buckets=3).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert all(r["n_chars"] == 0 and r["fingerprint"] == "" and r["near_edited"] == 1.0 for r in empty)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 8)}) == 1
    assert phrases.phrase_fingerprints(none).count() == 0
    alone = phrases.phrase_fingerprints(docs.filter("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def test_language_model(docs, none):
    model = ngrams.train(docs)
    got = {r["doc_id"]: r for r in ngrams.score(docs, model).collect()}
    assert all(got[k]["n_tokens"] == 1 and got[k]["n_known"] == 1 for k in (2, 3, 4))
    assert got[5]["n_tokens"] == 80_001 and all(r["score"] < 0 for r in got.values())
    assert ngrams.score(none, model).count() == 0
    blank = ngrams.train(none)
    assert {r["score"] for r in ngrams.score(docs, blank).collect()} == {0.0}


def test_extra_rows_keep_their_key_type(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "name string, body string")
    assert fm.classify(docs, fm.fit([]), "name", "body").columns == ["name", "score"]
    assert rows_of(simhash.simhash(docs, "name", "body").select("name", "component_id"), "name", "component_id") == [(False, "a", "a"), (False, "b", "b")]
    assert ngrams.score(docs, ngrams.train(docs, "body"), "name", "body").filter(F.col("name") == "b").first()["n_tokens"] == 1
