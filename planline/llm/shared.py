"""Shared storage, partition counts and byte-level text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none a temporary folder is made once and
    set on the session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="planline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: cuts lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.planline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    path = df.planline_path
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Keep the named columns alone, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a worker holds few texts as Python strings at once."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


#: 1 for bytes of a word after A-Z became a-z: 0-9, a-z and all beyond ASCII.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed one by one.
_LONG = 64


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of an array, eight bytes a step."""
    padded = np.concatenate((raw, np.zeros(8, dtype=np.uint8)))
    words = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, done = np.arange(len(start)), 0
    while len(at) and done < _LONG:
        left = size[at] - done
        word = words[start[at] + done]
        short = left < 8
        drop = np.where(short, (8 - np.maximum(left, 0)) * 8, 0).astype(np.uint64)
        word = np.where(left > 0, (word << drop) >> drop, 0) if short.any() else word
        out[at] = mix64(out[at] ^ word)
        done += 8
        at = at[size[at] > done]
    for k in at:
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes())
    return out


def folded_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes with A-Z folded to a-z, and begin and end of each word in them."""
    raw = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return raw, edge[::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order (A-Z folded to a-z)."""
    return span_hashes(*folded_spans(data))


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word runs of ``width``; a shorter text is one run."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix64(out + words[k : k + n] + np.uint64(k + 1))
    return np.unique(out)
