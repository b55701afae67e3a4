"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the id. A bucket over the byte limit - and only such a one
- splits on one more bit, until every shard fits. The directory is kept in pages of STEP bits: a page lists,
for each value of the next bits below an oversized bucket, the shard that it belongs to, or that the next page
decides. So a few deep buckets don't blow up one flat directory.

Sums are aggregated before they are shuffled; only the counts below oversized buckets are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import numbered, written

LIMIT = 32 << 20
STEP = 8
BITS = 128


def hash_bits(digest: Column) -> Column:
    """The first 64 bits of an md5 as text."""
    return F.lpad(F.conv(F.substring(digest, 1, 16), 16, 2), 64, "0")


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, further columns to keep, n_bytes, shard (the hash bits it shares), depth, shard_bytes, shard_docs and oversize of every row.

    A null or empty text has no bytes but a shard all the same. Rows of one id share 64 bits; past these they are
    told apart by a hash of their text and their place in the input, so that repeated rows split like any others.
    A document that alone is over the limit gets a shard of its own, marked oversize. Null ids hash as the empty
    text. An empty table gives an empty result. Other columns are not read.
    """
    own = hash_bits(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    more = hash_bits(F.md5(F.concat_ws(":", F.xxhash64("text").cast("string"), F.monotonically_increasing_id().cast("string")).cast("binary")))
    rows = docs.select(id_col, *keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.concat(own, more).alias("bits"))
    rows = written(rows, "shard-rows")
    whole = rows.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    if (whole["b"] or 0) <= limit or whole["n"] == 1:
        flat = [F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(whole["b"] or 0).cast("long").alias("shard_bytes"), F.lit(whole["n"]).cast("long").alias("shard_docs")]
        return marked(rows.select(id_col, *keep, "n_bytes", *flat), limit)
    done, left = [], rows
    for depth in range(0, BITS, STEP):
        to = depth + STEP
        left = left.withColumn("slot", F.substring("bits", 1, to))
        fine = written(left.groupBy("slot").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-sums")
        each = fine.select("slot", "b", "n", F.explode(F.sequence(F.lit(depth + 1), F.lit(to))).alias("depth")).withColumn("shard", F.expr("substring(slot, 1, depth)"))
        nodes = each.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fit = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)
        page = each.select("slot", "depth", "shard").join(nodes, "shard").where(fit)
        page = page.groupBy("slot").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("leaf")).select("slot", "leaf.*")
        page = written(page, "shard-page")
        done.append(left.join(page, "slot").select(id_col, *keep, "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"))
        left = written(left.join(page.select("slot"), "slot", "left_anti").drop("slot"), "shard-rows")
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return marked(out, limit)


def marked(rows: DataFrame, limit: int) -> DataFrame:
    return rows.withColumn("oversize", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id") -> None:
    """The documents as Parquet, a folder a shard (shard=b<bits>, `b` alone for an undivided table). A shard is written by one task: it fits the limit.

    Every row is written once, repeated rows as often as they occur. An empty table writes no shard.
    """
    rows = written(docs.select(*numbered(docs), F.monotonically_increasing_id().alias("_row")), "shard-input")
    own = rows.select(F.col(f"k{docs.columns.index(id_col)}").alias("id"), F.col(f"k{docs.columns.index('text')}").alias("text"), "_row")
    where = shards(own, limit, "id", ("_row",)).select("_row", "shard")
    placed = rows.join(where, "_row")
    out = placed.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)), F.concat(F.lit("b"), "shard").alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


#: The same in SQL, for ids that are not repeated.
SQL = """
with d as (
  select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
         lpad(bin(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 16) as ubigint)), 64, '0') as bits
  from documents),
e as (select d.doc_id, d.n_bytes, k.depth, substr(d.bits, 1, k.depth) as shard from d, (select unnest(range(0, 65)) as depth) k),
n as (select shard, sum(n_bytes) as shard_bytes, count(*) as shard_docs from e group by shard),
f as (
  select e.doc_id, e.n_bytes, e.shard, e.depth, n.shard_bytes, n.shard_docs,
         row_number() over (partition by e.doc_id order by e.depth) as rn
  from e join n on e.shard = n.shard where n.shard_bytes <= {limit} or n.shard_docs = 1)
select doc_id, n_bytes, shard, cast(depth as integer) as depth, cast(shard_bytes as bigint) as shard_bytes,
       shard_docs, shard_bytes > {limit} as oversize
from f where rn = 1
"""
