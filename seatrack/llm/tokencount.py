"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
MEMO = 400_000
_SPACES = re.compile("▁+[^▁]*")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: a changed file never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a SentencePiece model.

    If no piece holds a space mark behind another character, and the model changes no characters,
    merges never cross into the next run of space marks: a text is then counted part by part, and
    parts met before come from a memo of bounded size. Other models encode whole texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    apart = (not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
             and model.normalize("ａ  é́ x") == "▁ａ▁▁é́▁x")
    # No text gives one space mark alone, which a space at the end leaves: the empty part stands for it.
    memo = {"": 3 if model.is_unknown(model.piece_to_id("▁")) else 1}

    def parts(text: str) -> list[str]:
        cut = text.split(" ")
        if "▁" not in text and "" not in cut:
            return cut
        # A run of k marks is what the model makes of k - 1 spaces before a part.
        return [" " * (len(m) - len(m.lstrip("▁")) - 1) + m.lstrip("▁") for m in _SPACES.findall("▁" + text.replace(" ", "▁"))]

    def count(texts: list[str]) -> list[int]:
        if not apart:
            return [len(x) for x in model.encode(texts, num_threads=1)]
        cut = [parts(t) if t else [] for t in texts]
        new = list({p for c in cut for p in c if p not in memo})
        fresh = dict(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
        if len(memo) + len(fresh) <= MEMO:
            memo.update(fresh)
            return [sum(map(memo.__getitem__, c)) for c in cut]
        return [sum(memo[p] if p in memo else fresh[p] for p in c) for c in cut]

    return count


def json_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a tokenizers file, special strings as the library handles them by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e.ids) for t in texts for e in tok.encode_batch([t], add_special_tokens=False)]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path) if path.endswith(".model") else json_counter(path)
        for b in batches:
            texts = b.column("_text")
            sums = [n for i in range(0, len(texts), 256) for n in count(texts[i:i + 256].to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_digest"), pa.array(sums, pa.int64())], ["digest", "n_tokens"])

    return encode


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where the cache doesn't exist yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text",
                 normalise: Callable = lambda c: F.coalesce(c, F.lit(""))) -> DataFrame:
    """One row (key, n_bytes, n_tokens) per document of ``docs``.

    ``normalise`` must not change counts; by default a null text becomes the empty one, which has no
    tokens. Digests of all texts meet the stored counts of this tokenizer version; of those without
    a count, one document each is encoded, and the new counts are appended to ``cache`` (Parquet,
    one writer at a time). A second run encodes nothing. Rows with null or repeated keys are counted
    like any other; very long texts are split into parts, not cut.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    body = normalise(F.col(text))
    rows = docs.select(F.col(key).alias("_key"), body.alias("_text"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    short = rows.select("_key", "_digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    missing = (short.groupBy("_digest").agg(F.min("_key").alias("_rep"))
               .join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
               .withColumnRenamed("_digest", "_miss"))
    texts = rows.join(missing, rows["_key"].eqNullSafe(missing["_rep"]) & (rows["_digest"] == missing["_miss"]))
    fresh = texts.select("_digest", "_text").mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
    (fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
     .select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    return (short.join(stored, short["_digest"] == stored["digest"])
            .select(F.col("_key").alias(key), "n_bytes", "n_tokens"))
