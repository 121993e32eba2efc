"""Rules on single documents, and lines that recur in many documents of a host. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Lines in more than this share of a host's documents are above its limit, but never those in so few of them or fewer.
SHARE, LEAST = 0.05, 3


GAPS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``; splitting at one character needs no regular expression."""
    for gap in GAPS[1:]:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of these ASCII characters a text holds."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return sum(counts[1:], counts[0])


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes.

    Only documents with a repeated window reach the sorting branch. Repeated windows start at sorted
    positions p1 < p2 < ...; each adds the words up to the next start, at most a window.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.transform(F.array(pairs), lambda a: F.array_sort(F.transform(
        F.filter(F.transform(a, lambda x, i: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(a, i - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]),
        lambda x: x["i"])))[0]
    covered = F.transform(F.array(starts), lambda s: F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x))[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def _window_hashes(words: Column) -> Column:
    """A hash for each run of ``WINDOW`` words, in order."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))[0]


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (null text: all zero).

    Windows compare by a 64-bit hash of the 64-bit hashes of their words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (docs.withColumn("_llm_words", words_of(body))
            .withColumn("_llm_windows", _window_hashes(F.col("_llm_words")))
            .withColumn("n_words", F.size("_llm_words").cast("long"))
            .withColumn("word_chars", (F.length(body) - count_of(body, GAPS)).cast("long"))
            .withColumn("n_symbols", count_of(body, SYMBOLS).cast("long"))
            .withColumn("n_dup_lines", F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long"))
            .withColumn("n_repeat_words", _repeated_words(F.col("_llm_windows")))
            .drop("_llm_words", "_llm_windows"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _with_row(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The columns that tell rows apart. Rows alike in all three get the same result."""
    return docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"),
                       F.coalesce(F.col(text), F.lit("")).alias("_body")).withColumn("_digest", F.xxhash64("_body"))


def _normal(line: Column) -> Column:
    return F.lower(F.array_join(words_of(line), " "))


def _line_rows(rows: DataFrame) -> DataFrame:
    """A row per line with a word: its hash and number of words."""
    out = rows.select("_key", "_host", "_digest", F.posexplode(F.transform(F.split("_body", "\n", -1), _normal)).alias("_pos", "_line"))
    return out.filter("_line != ''").select(
        "_key", "_host", "_digest", "_pos", F.xxhash64("_line").alias("_hash"), (count_of(F.col("_line"), " ") + 1).alias("_words"))


def _left_by_row(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``more`` has for them, else null."""
    more = more.withColumnsRenamed({"_key": "_k", "_host": "_h", "_digest": "_d"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_digest") == F.col("_d"))
    return rows.join(more, same, "left")


def frequent_lines(rows: DataFrame, lines: DataFrame, share: float, least: int) -> DataFrame:
    """(host, line hash) of lines found in more distinct documents of a host than its limit.

    Rows alike in key and text are one document; a line counts once in a document. The limit is ``share`` of the host's documents,
    and ``least`` where that is fewer, so it acts on hosts of every size. All counts combine before the shuffle, so neither a host nor
    a line is gathered in one task.
    """
    document = F.xxhash64("_key", "_digest").alias("_doc")
    hosts = (rows.select("_host", document).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
             .withColumnRenamed("_host", "_h"))
    found = (lines.select("_host", "_hash", document).distinct().groupBy("_host", "_hash")
             .agg(F.count("*").alias("_in")).filter(F.col("_in") > least))
    return (found.join(hosts, F.col("_host").eqNullSafe(F.col("_h")))
            .filter(F.col("_in") > F.greatest(F.lit(least), F.col("_docs") * share))
            .select(F.col("_host").alias("_h"), F.col("_hash").alias("_over")))


def _hits(rows: DataFrame, share: float, least: int) -> DataFrame:
    lines = _line_rows(rows)
    over = frequent_lines(rows, lines, share, least)
    return lines.join(over, (lines["_hash"] == over["_over"]) & lines["_host"].eqNullSafe(over["_h"]))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE,
                  least: int = LEAST, depleted: float = 0.5, min_words: int = 20) -> DataFrame:
    """One row per document: key, the measures, ``base_failed``, ``n_frequent_words`` and ``kept``.

    A line (lower case, single spaces) is above the limit of its host if it is in more than ``least`` and
    more than ``share`` of the host's distinct documents. A document is depleted if without these lines it
    has fewer than ``min_words`` words, or lost more than ``depleted`` of them. A null host is a host of
    its own; a null text has no words and fails; repeated rows each get their row.
    """
    rows = _with_row(docs, key, text, host)
    lost = (_hits(rows, share, least).groupBy("_key", "_host", "_digest", "_pos").agg(F.max("_words").alias("_words"))
            .groupBy("_key", "_host", "_digest").agg(F.sum("_words").alias("_removed")))
    removed = F.coalesce(F.col("_removed"), F.lit(0).cast("long"))
    return _left_by_row(text_measures(rows, "_body"), lost).select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), removed.alias("n_frequent_words"),
        (~base_failed() & (F.col("n_words") - removed >= min_words) & (removed <= depleted * F.col("n_words"))).alias("kept"))


def without_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                           share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row (key, text) per document: the text without its lines above the limit of the host."""
    rows = _with_row(docs, key, text, host)
    gone = (_hits(rows, share, least).groupBy("_key", "_host", "_digest").agg(F.collect_set("_hash").alias("_gone")))
    none = F.array().cast("array<bigint>")
    kept = F.filter(F.split("_body", "\n", -1), lambda x: ~F.array_contains(F.coalesce(F.col("_gone"), none), F.xxhash64(_normal(x))))
    return _left_by_row(rows, gone).select(F.col("_key").alias(key), F.array_join(kept, "\n").alias(text))
