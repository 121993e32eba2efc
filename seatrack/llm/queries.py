"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrack.llm import collocations, crf, decontaminate, fm, mixing, ngrams, packing, phrases, quality, simhash, store, substring, tokencount, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and its verdict by recurring lines."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLES["op4_quality_rules"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, i, list_slice(w, i, i + 7) AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM docs WHERE len(w) >= 8)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM repeated) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, text, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS lw
  FROM (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
solid AS (SELECT r, doc_id, source, text, line, len(lw) AS n, lower(array_to_string(lw, ' ')) AS norm FROM lines WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY r),
hosts AS (SELECT source, count(DISTINCT (doc_id, text)) AS n FROM docs GROUP BY source),
freq AS (SELECT s.source, norm FROM solid s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  GROUP BY s.source, norm, h.n HAVING count(DISTINCT (doc_id, text)) > greatest({quality.LEAST}, h.n * {quality.SHARE})),
lost AS (SELECT r, sum(s.n) AS n FROM solid s JOIN freq f ON s.source IS NOT DISTINCT FROM f.source AND s.norm = f.norm GROUP BY r),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS lost
  FROM docs d LEFT JOIN dup USING (r) LEFT JOIN covered c USING (r) LEFT JOIN lost l USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, lost::BIGINT AS n_frequent_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost >= 20 AND lost <= 0.5 * n_words AS kept
FROM m"""


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document and the training times of its copies."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("order_hash", "source")


_SEGMENTS = [  # class, area before, area to the end, whole area, time, weight, slope of each piece of the schedules
    (c, sum(areas[:k]), sum(areas[:k + 1]), sum(areas), points[k][0], points[k][1],
     (points[k + 1][1] - points[k][1]) / (points[k + 1][0] - points[k][0]))
    for c, points in enumerate(mixing.SCHEDULES)
    for areas in [[(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])]]
    for k in range(len(areas))]


def _time_sql(start: str) -> str:
    share = f"({start}) / target"
    cases = " ".join(
        f"WHEN class = {c} AND {share} * {whole} <= {until} THEN least({t} + 2 * greatest({share} * {whole} - {done}, 0) / "
        f"({w} + sqrt(greatest({w} * {w} + 2 * {slope} * greatest({share} * {whole} - {done}, 0), 0))), 1)"
        for c, done, until, whole, t, w, slope in _SEGMENTS)
    return f"CASE WHEN greatest(0, least(size, wanted - ({start}))) > 0 THEN CASE {cases} ELSE 1 END END"


ORACLES["op8_mix_sources"] = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '-' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS class FROM docs GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][class + 1]::DOUBLE AS w, 2 * total AS cap FROM s),
l AS (SELECT *, (sum(total) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, class, total::BIGINT AS total, least(cap, coalesce(max(CASE WHEN cap / w >= lev THEN lev END) OVER () * w, cap)) AS target FROM l),
p AS (SELECT doc_id, size, total, target, class, round(target)::BIGINT AS wanted,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM docs d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
  (greatest(0, least(size, wanted - ahead)) + greatest(0, least(size, wanted - total - ahead)))::BIGINT AS taken,
  {_time_sql("ahead")} AS first_position, {_time_sql("total + ahead")} AS second_position
FROM p"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the cache starts empty and lies in the shared folder."""
    import public_tokenizers

    counts = tokencount.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), store.shared_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def key_hash(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fm.train(docs, labels.filter(key_hash(5) != 0))
    return fm.classify(docs, model).select(
        "doc_id", (key_hash(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = crf.train(docs.filter(key_hash(4) != 2))
    return crf.predict(docs, model).select("doc_id", (key_hash(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.simhash(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and of its edit."""
    return phrases.phrase_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that are kept in another document."""
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = key_hash(10) == 0
    scored = ngrams.score(docs, ngrams.train(docs.filter(~held_out)))
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = rf"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM pieces, range(1, 5) AS ks(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, l.f AS l, r.f AS r, cut, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM grams WHERE k > 1) c
  JOIN grams l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, cut)
  JOIN grams r ON r.lang = c.lang AND r.g = list_slice(c.g, cut + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT DISTINCT lang, list_slice(g, s, s + m - 1) AS g, f
  FROM (SELECT lang, k, g, f, m, unnest(generate_series(1, k - m + 1)) AS s FROM grams, range(2, 4) AS ms(m) WHERE k > m)),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = b.lang AND p.g = b.g AND 100 * p.f >= 80 * b.a)),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
    array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent near spelling and root of every word of the documents."""
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents")))


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    models = decontaminate.automata(table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(table(spark, sf_dir, "documents"), models)


_PLAIN = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
ORACLES["op13_decontamination"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_PLAIN} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
hits AS (
  SELECT r, i, size, item
  FROM (SELECT r, size, i, list_slice(w, i, i + size - 1) AS win
    FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
      FROM docs, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)) JOIN wins USING (size, win)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)"""
