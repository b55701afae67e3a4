"""Scans and sinks: run directories, JSON lines, score sheets, checked archives, web bytes, resumable append, guarded export."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_directory(spark: SparkSession, path: str) -> DataFrame:
    """doc (file name up to its first _), body: one JSON file a document, summary.json left out. A body that is no JSON is null."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("name", name).where("name <> 'summary.json'")
    good = F.expr("try_parse_json(value)").isNotNull()
    return rows.select(F.regexp_extract(F.regexp_replace("name", r"\.json$", ""), r"^([^_]*)", 1).alias("doc"), F.when(good, F.col("value")).alias("body"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line, by a given schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def score_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV sheet with a header, all columns text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)


def write_score_sheet(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def parquet_shard(spark: SparkSession, path: str, columns: list[str], seed: str, key: str) -> DataFrame:
    """Some columns of a shard with the seeded hash that orders it; rows are not sorted before they must be."""
    return spark.read.parquet(path).select(*columns).withColumn("rank_key", F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name and sha256 of every file of bytes under a path: the manifest that freezes it."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def checked_lines(spark: SparkSession, path: str, manifest: DataFrame | str, schema: str) -> DataFrame:
    """JSON lines of the (gzip) files under a path after their sha256 are checked: against a manifest, or one digest for one file."""
    found = digests(spark, path)
    if isinstance(manifest, str):
        manifest = found.select("name").limit(2).withColumn("sha256", F.lit(manifest))
    other = found.join(manifest, ["name", "sha256"], "full_outer")
    wrong = other.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").unionAll(found.join(manifest, "name", "left_anti").select("name", F.lit(1))).unionAll(manifest.join(found, "name", "left_anti").select("name", F.lit(1)))
    if not wrong.isEmpty() or found.isEmpty():
        raise ValueError(f"{path} is not what was frozen")
    return spark.read.schema(schema).json(path)


def rewritten_sheet(sheet: DataFrame, column: str, derived: Column) -> DataFrame:
    """A score sheet with a derived column worked out anew, and whether each row had another value before."""
    return sheet.withColumn("rewritten", ~F.col(column).eqNullSafe(derived)).withColumn(column, derived)


def repaired(text: Column, pairs: dict[str, str]) -> tuple[Column, Column]:
    """text with wrong letters replaced, and how many were."""
    n = sum((F.length(text) - F.length(F.replace(text, F.lit(a), F.lit("")))) for a in pairs) if pairs else F.lit(0)
    out = text
    for a, b in pairs.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out, n


def web_bytes(spark: SparkSession, path: str, encoding: str, pairs: dict[str, str]) -> DataFrame:
    """path, text, n_repaired of files of bytes in a declared code page."""
    text, n = repaired(F.decode("content", encoding), pairs)
    return spark.read.format("binaryFile").load(path).select("path", text.alias("text"), n.alias("n_repaired"))


def _run_starts(batch: pa.RecordBatch, n: int) -> list[int]:
    """Rows at which one of the first n columns differs from the row before; nulls are alike."""
    if batch.num_rows == 0:
        return []
    new = np.zeros(batch.num_rows - 1, bool)
    for c in batch.columns[:n]:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def fingerprints(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """n and a sha256 of each slice's set of keys: keys are hashed in order in 256 groups by the first digits of their hash, then the groups' hashes in order.

    Keys are sorted by the shuffle and hashed as they pass, so no list grows with the slice. A null key counts in n only;
    a slice of such has no hash.
    """
    k, kinds = F.col(key).cast("string"), dict(rows.dtypes)
    names = [f"_by{i}" for i in range(len(by))]
    each = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.substring(F.sha2(k, 256), 1, 2).alias("_g"), k.alias("_k"))
    dealt = each.repartition(*names, "_g").sortWithinPartitions(*names, "_g", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, n = None, None, 0  # the slice and group whose keys pass

        def done() -> pa.RecordBatch:
            ends = [pa.array([sha and sha.hexdigest()], pa.string()), pa.array([n], pa.int64())]
            return pa.RecordBatch.from_arrays([*own.columns, *ends], names=[*names, "g", "h", "n"])

        for b in batches:
            starts = _run_starts(b, len(names) + 1)
            for at, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                head = b.select([*names, "_g"]).slice(at, 1)
                if own is None or at > 0 or len(_run_starts(pa.concat_batches([own, head]), len(names) + 1)) > 1:
                    if own is not None:
                        yield done()
                    own, sha, n = head, None, 0
                n += end - at
                if head.column(len(names)).null_count == 0:
                    text = "\n".join(b.column("_k").slice(at, end - at).to_pylist()).encode()
                    if sha is None:
                        sha = hashlib.sha256(text)
                    else:
                        sha.update(b"\n" + text)
        if own is not None:
            yield done()

    groups = dealt.mapInArrow(run, ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(by, names, strict=True)), "g string, h string, n long"]))
    met = F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("g", "h"))))  # 256 at most
    sha = F.when(F.size(met) > 0, F.sha2(F.array_join(F.transform(met, lambda x: x["h"]), "\n"), 256))
    return groups.groupBy(*names).agg(F.sum("n").alias("n"), sha.alias("sha")).select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), "n", "sha")


def still_to_do(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items that an earlier run has not written."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def ledger_of(spark: SparkSession, path: str) -> DataFrame | None:
    """A row for each append at path: its name, rows, and the range of its keys; None before the first."""
    try:
        return spark.read.parquet(f"{path}/_ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def appended(spark: SparkSession, path: str, among: DataFrame | None = None) -> DataFrame | None:
    """The rows of all appends (or of those `among` them) that the ledger has; None where there is none."""
    ledger = among if among is not None else ledger_of(spark, path)
    names = [r["append"] for r in ledger.select("append").collect()] if ledger is not None else []  # a row an append
    return spark.read.option("basePath", path).parquet(*(f"{path}/append={x}" for x in names)).drop("append") if names else None


def append_missing(items: DataFrame, path: str, *keys: str) -> int:
    """Appends what is not at path yet; returns how many rows that were.

    A ledger beside the rows has the range of the keys of each append, so only the keys of appends that new rows may
    collide with are read: for keys that grow with time, the last ones. An append counts from when its ledger row is
    written; what a lost run left without one is not read by appended(). One writer at a time. Rows that are alike
    within items are all appended.
    """
    spark, key = items.sparkSession, F.struct(*keys)
    items = items.persist()
    try:
        low, high = items.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        if low is None:
            return 0
        ledger = ledger_of(spark, path)
        if ledger is not None:
            new = items.agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
            ledger = ledger.join(F.broadcast(new), (F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low")))
        done = appended(spark, path, ledger) if ledger is not None else None
        name = uuid.uuid4().hex
        (items if done is None else still_to_do(items, done, *keys)).write.parquet(f"{path}/append={name}")
        put = spark.read.schema(items.schema).parquet(f"{path}/append={name}").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        n = put.first()["n"]
        if n:
            put.select(F.lit(name).alias("append"), "n", "low", "high").write.mode("append").parquet(f"{path}/_ledger")
        return n
    finally:
        items.unpersist()


def exportable(grouped: DataFrame, count: str, least: int) -> DataFrame:
    """Groups of at least so many members; a frame without that count is refused."""
    if count not in grouped.columns:
        raise ValueError("only grouped rows with their counts may leave")
    return grouped.where(F.col(count) >= least)
