"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here: a null text counts as the empty text, rows with equal
keys are kept as they are, and extra input columns are ignored (each operator selects what it needs
and names its working columns itself, so a clash of names can't arise).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that separate words: [\x20\x09-\x0D]. bytes.split() uses just these.
SPACES = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent (tests), a local session gets a temporary folder; a cluster session
    without it is refused, since executors would not see one another's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tripfold-")
    return f"{base.rstrip('/')}/tripfold-{uuid.uuid4().hex}"


def lean(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most 1,000 rows and 16 MB: texts are long, and a worker holds a
    batch as bytes and as Python objects at the same time."""
    for key, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))
    return spark


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: lineage ends here, and a
    lost executor costs a re-read instead of the whole job."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MARKS = ("_mark_a", "_mark_b")


def with_marks(df: DataFrame) -> DataFrame:
    """df and MARKS: two 64-bit hashes of each row's columns, nulls kept apart from other values."""
    all_ = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    return df.withColumns({m: F.xxhash64(F.lit(k), *all_) for k, m in enumerate(MARKS)})


def crc_mod(col, n: int):
    """crc32 of the id's decimal text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def one_of_each_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text and _y for the ids (_id, _y; their number is bounded, so they are broadcast): one row an id,
    however many rows of docs have it, with the first of their texts in order. A null text is an empty one."""
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("_y").alias("_y"))


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Two of k words share one by chance in k*k/2**65 cases."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """x, scrambled: each result bit depends on each bit of x and of the salt."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles.

    A-Z are lower-cased and words are [^\\x20\\x09-\\x0D]+. A text with fewer than n words has its whole
    word sequence as its one shingle, and one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(hash_words(words), min(n, len(words))))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the hashes of the words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9FB21C651E98DF25) + mixed(h[k : len(h) - n + 1 + k], k + 1)
    return mixed(out, n)


def bounds_of(df: DataFrame, key: str, n: int) -> list:
    """At most n-1 ascending values of key that cut its rows into n parts of about one size.

    Only the key column is read. The result has n-1 numbers whatever the input's size.
    """
    if n < 2:
        return []
    shares = [k / n for k in range(1, n)]
    got = df.select(F.percentile_approx(F.col(key), shares, 20 * n).alias("b")).first()
    return sorted(set(got["b"] or []))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
