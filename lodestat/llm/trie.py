"""A prefix trie of conversations from their sorted order, without a stack.

Conversations are sequences of turns; a turn is the hash of its role and text. Distinct sequences are sorted, and
between neighbours stands the number of turns that they share. A trie node is a stretch of that order: every prefix
that a sequence does not share with the one before it is a candidate, and two binary searches over a sparse table of
range minima, one to the left for where its parent begins and one to the right for where it ends itself, give the
stretches. What is asked of a subtree (members, leaves, saved words) is then a difference of running sums.

The order is cut into blocks by range, so a prefix that a third of all conversations begin with lies across many
tasks. Only the prefixes that cross an edge of a block ("open") are summed up over blocks, by their hash; equal
sequences are one row before they are sorted. The edges are one row a block. A block holds some BLOCK_TURNS hashes of
turns, never texts. One conversation is one row there: 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import crc32_sql, key_col, written

#: Turns of distinct sequences in a block, on average.
BLOCK_TURNS = 1 << 18
#: Ids that are joined to one string before those of one sequence meet.
PIECE = 1024
#: Bytes of a turn's hash.
TURN = 16
WORD = r"[^\x20\x09-\x0D]+"
_PARTS = "key binary, parent_key binary, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv, toks array<string>, words array<int>: the turns of each conversation in order, as hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tok = F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), tok.alias("tok"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.select(key_col("conv_id").alias("conv"), turn.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv", F.col("t.tok").alias("toks"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Sequences that begin with the first h turns of the first conversation of their group, h = crc32(id) % heads."""
    first = own.select(F.col("conv").alias("anchor"), F.slice("toks", 1, heads - 1).alias("head"), F.slice("words", 1, heads - 1).alias("head_words"))
    known = F.col("conv") != -(2**63)
    h = (F.crc32(F.when(known, F.col("conv").cast("string")).otherwise("").cast("binary")) % heads).cast("int")
    rows = own.withColumn("h", h).withColumn("anchor", F.when(known, F.col("conv") - F.col("conv") % group)).join(first, "anchor", "left")

    def put(head: str, tail: str) -> F.Column:
        return F.concat(F.slice(F.coalesce(head, F.slice(tail, 1, 0)), F.lit(1), F.col("h")), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail) - F.col("h"), F.lit(0))))

    return rows.select("conv", put("head", "toks").alias("toks"), put("head_words", "words").alias("words"))


def id_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from key, conv: SHA-256 of the ids of a key, ascending and joined by commas.

    The ids of a key that many have are sorted and joined to strings in many tasks; one hashes the strings in order.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, out = None, None, [], ([], [], [])

        def put() -> None:
            if ids:
                for column, x in zip(out, (key, first, ",".join("" if i == -(2**63) else str(i) for i in ids)), strict=True):
                    column.append(x)

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["key", "first", "ids"])
            for column in out:
                column.clear()
            return b

        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or len(ids) >= PIECE:
                    put()
                    key, first, ids = k, c, []
                ids.append(c)
            yield batch()
        put()
        yield batch()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    pieces = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(joined, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")


def minima(x: np.ndarray) -> list[np.ndarray]:
    """A sparse table: minima[k][i] is the least of x[i : i + 2 ** k]."""
    out = [x]
    while 2 * (half := 1 << (len(out) - 1)) <= len(x):
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of x[left : right + 1] for each pair of places."""
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] + 1 - (1 << level)])
    return out


def right_end(shared: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row that shares depth turns with row at: the reach is searched for by halves."""
    n, to = len(shared[0]), at + 1
    for k in range(len(shared) - 1, -1, -1):
        fits = to + (1 << k) <= n
        go = fits & (shared[k][np.where(fits, to, 0)] >= depth)
        to = to + (go << k)
    return to - 1


def left_end(shared: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row that shares depth turns with row at."""
    to = at.copy()
    for k in range(len(shared) - 1, -1, -1):
        fits = to - (1 << k) >= 0
        go = fits & (shared[k][np.where(fits, to - (1 << k) + 1, 0)] >= depth)
        to = to - (go << k)
    return to


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // TURN
    differ = np.flatnonzero(np.frombuffer(a, np.int64, 2 * n) != np.frombuffer(b, np.int64, 2 * n))
    return int(differ[0]) // 2 if len(differ) else n


def prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """Hashes of the first 0, 1, ... depth turns."""
    state = xxhash.xxh3_128()
    out = [state.digest()]
    for d in range(depth):
        state.update(seq[d * TURN : (d + 1) * TURN])
        out.append(state.digest())
    return out


def block_nodes(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """The nodes of one block of sorted distinct sequences; those that cross an edge come with their key, as a part of a node."""
    seqs = rows["seq"].to_pylist()
    order = sorted(range(len(seqs)), key=seqs.__getitem__)
    seqs = [seqs[i] for i in order]
    n = len(seqs)
    conv, count = (rows[c].to_numpy()[order] for c in ("conv", "n"))
    ends, words = (rows[c].take(pa.array(order)).to_pylist() for c in ("ends_sha256", "words"))
    before, after = edges["before"][0].as_py(), edges["after"][0].as_py()
    from_before = -1 if before is None else common_turns(before, seqs[0])
    to_after = -1 if after is None else common_turns(seqs[-1], after)

    size = np.array([len(s) // TURN for s in seqs], np.int64)
    lcp = np.array([-1, *map(common_turns, seqs[:-1], seqs[1:])], np.int64)
    shared = minima(lcp)
    # candidates: each prefix of a row that the row before it in this block doesn't have
    new = size - lcp
    base = np.cumsum(new) - new
    row = np.repeat(np.arange(n), new)
    depth = np.arange(len(row)) - base[row] + lcp[row] + 1
    end = right_end(shared, row, depth)
    up = np.maximum(depth - 1, 0)
    top = left_end(shared, row, up)
    parent = base[top] + up - lcp[top] - 1
    going_on = (row == 0) & (depth <= from_before)

    so_far = [np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words]
    total = np.array([w[-1] for w in so_far], np.int64)
    seen = np.array([w[max(0, k)] for w, k in zip(so_far, [from_before, *lcp[1:].tolist()], strict=True)], np.int64)
    above = np.concatenate([w[np.maximum(np.arange(k, len(w)) - 1, 0)] for w, k in zip(so_far, (lcp + 1).tolist(), strict=True)])
    leaf = np.append(lcp[1:], to_after) < size

    def over(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return run[end + 1] - run[first]

    members = over(count, row)
    saved = over((count - 1) * total, row) + over(seen, row + 1 - going_on) - above * (members - 1 + going_on)
    children = np.bincount(parent[(depth > 0) & ~going_on], minlength=len(row))
    open_left, open_right = going_on, (end == n - 1) & (depth <= to_after)
    keys = prefix_keys(seqs[0], from_before + 1 if from_before >= 0 else 0), prefix_keys(seqs[-1], to_after + 1 if to_after >= 0 else 0)
    key = [keys[0][d] if a else keys[1][d] if b else None for d, a, b in zip(depth.tolist(), open_left.tolist(), open_right.tolist(), strict=True)]
    least_conv = least(minima(conv), row, end)
    parent_key = [key[p] if d else None for p, d in zip(parent.tolist(), depth.tolist(), strict=True)]
    own_end = np.where((depth == size[row]), row, -1).tolist()
    cols = [
        pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(depth), pa.array(least_conv), pa.array(least_conv[parent], mask=depth == 0), pa.array(members),
        pa.array(children), pa.array(over(leaf.astype(np.int64), row)), pa.array(saved), pa.array([ends[i] if i >= 0 else None for i in own_end], pa.string()),
    ]
    return pa.table(cols, names=[x.split()[0] for x in _PARTS.split(", ")])


def trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node, from conv, toks and words of every conversation."""
    rows = sequences.select("conv", F.unhex(F.array_join("toks", "")).alias("seq"), "words").withColumn("key", F.unhex(F.md5("seq")))
    rows = written(rows, "trie-sequences")
    same = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    distinct = written(same.join(id_digests(rows), "key").drop("key"), "trie-distinct")
    turns = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    blocks = written(distinct.repartitionByRange(max(1, math.ceil(turns / BLOCK_TURNS)), "seq").withColumn("block", F.spark_partition_id()), "trie-blocks")
    by_block = Window.orderBy("block")  # one row a block
    edges = blocks.groupBy("block").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    edges = edges.select("block", F.lag("most").over(by_block).alias("before"), F.lead("least").over(by_block).alias("after"))
    parts = blocks.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(block_nodes, _PARTS)
    parts = written(parts, "trie-parts")
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    crossing = parts.where("key is not null").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), *summed, F.max("ends_sha256").alias("ends_sha256"))
    crossing = written(crossing.withColumn("parent_conv", F.lit(None).cast("long")), "trie-crossing")
    parents = crossing.select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    nodes = parts.where("key is null").unionByName(crossing).join(parents, "parent_key", "left")
    shown = lambda c: F.when(c != -(2**63), c)
    return nodes.select(
        shown(F.col("conv")).alias("conv_id"), "depth", shown(F.coalesce("found", "parent_conv")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with the heads of their groups put before them.

    Turns stand in the order of turn (null first), equal ones by role and hash, and each of repeated rows is a turn.
    A null role or text counts as empty. Rows whose conv_id is null are one conversation: least of all, its id
    written as nothing, without a head of others. A conversation without turns ends at the root. conv_id is of any
    integer type. An empty table has no members and gives an empty result. Other columns are not read.
    """
    return trie(rebuilt(sequences(conversations)))


#: Prefixes are strings of md5 of turns, so an ancestor is the beginning of a string.
SQL = f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, md5(md5(coalesce(role, '')) || coalesce(text, '')) as tok,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations),
own as (select conv_id, list(tok order by turn nulls first, role, tok) as toks, list(words order by turn nulls first, role, tok) as words,
    {crc32_sql('conv_id::varchar')} % 4 as h from turns group by conv_id),
seqs as (select o.conv_id, list_concat(coalesce(d.toks, [])[1:o.h], o.toks[o.h + 1:]) as toks, list_concat(coalesce(d.words, [])[1:o.h], o.words[o.h + 1:]) as words
    from own o left join own d on d.conv_id = o.conv_id - o.conv_id % 20),
prefixes as (select conv_id, d, array_to_string(toks[1:d], '') as p, case when d = 0 then 0 else words[d] end as w, len(toks) = d as ends
    from (select *, unnest(range(len(toks) + 1)) as d from seqs)),
nodes as (select d as depth, p, left(p, 32 * (d - 1)) as up, any_value(w) as w, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids from prefixes group by d, p),
children as (select up, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
sums as (select left(p, 32 * a) as p, a as depth, sum(w * (n_convs - 1)) as saved, count(*) filter (leaf) as leaves
    from (select x.*, c.n is null as leaf, unnest(range(x.depth + 1)) as a from nodes x left join children c on c.up = x.p and c.depth = x.depth) group by all)
select x.conv_id::bigint as conv_id, x.depth::bigint as depth, u.conv_id::bigint as parent_conv_id, x.n_convs::bigint as n_convs, coalesce(c.n, 0)::bigint as n_children,
    s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(x.ids) as ends_sha256
from nodes x join sums s on s.p = x.p and s.depth = x.depth left join children c on c.up = x.p and c.depth = x.depth left join nodes u on x.depth > 0 and u.p = x.up and u.depth = x.depth - 1
"""
