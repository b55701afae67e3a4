"""What the corpus operators share: written tables, word splitting, hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text that are split into words at a time.
SPLIT_BYTES = 4 << 20
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only on a local master, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        there = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        there.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def released(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs removed now.

    They go when the driver's JVM collects what refers to them, which with much free memory is long after the table that
    they were for is written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(name: str) -> F.Column:
    """A hash of a whole text that stands for it; null counts as empty."""
    return F.md5(F.coalesce(F.col(name), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame, prefix: str = "k") -> list[F.Column]:
    """All columns of docs under names that clash with none of ours: k0, k1, ..."""
    return [F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(docs.columns)]


def renamed(rows: DataFrame, names: list[str], prefix: str = "k") -> DataFrame:
    """The columns k0, k1, ... under their own names again."""
    return rows.select(*(F.col(f"{prefix}{i}").alias(c) for i, c in enumerate(names)))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_runs(raw: bytes, size: int = SPLIT_BYTES) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, some megabytes at a time, cut at white space only."""
    if len(raw) <= size:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        yield raw[at:end].split()
        at = end


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words `[^\\x20\\x09-\\x0D]+` of a text start and end."""
    word = ~_IS_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    return edge[::2], edge[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that near numbers and low bits no longer look alike."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_col(name: str) -> F.Column:
    """The id for comparison; null is as the least of all."""
    return F.coalesce(F.col(name), F.lit(-(2**63)))


def decoded(column: pa.Array) -> list[str]:
    """The texts; null counts as empty, bytes that are no UTF-8 as U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def strings(raw: list[bytes | None]) -> pa.Array:
    """Texts from their bytes, valid UTF-8 or not."""
    return pa.array(raw, pa.binary()).view(pa.string())


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, _CONTINUED))


_CONTINUED = bytes(range(0x80, 0xC0))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit: every byte is followed by eight steps (-1)."""
    units = f"list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({units}, lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
