"""Vector best-fit packing of token sequences.

A document takes up three things in a bin: tokens, one of the places for documents, and attention cost (the square
of its length). Pieces of one length are alike, so the plan is made from the counts of pieces by length - at
most as many as the bin has tokens, whatever the size of the corpus - and each piece then finds its bin by its
rank among the pieces of its length. Ranks are counted in two levels (within a task, then over tasks), so that no
length has to meet in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import decoded, written

PIECES = "piece int, start long, length long, ids_crc32 long"
END_ID = 2
#: Chunks whose ids a task remembers.
CACHE = 300_000


class ChunkIds(dict):
    """Ids of " " + chunk, as little-endian 32-bit bytes, remembered."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = as_bytes(self.encode(" " + chunk))
        if len(chunk) < 64:
            self[chunk] = out
        return out


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a whole text by the tokenizer file at path, without special tokens added.

    In byte-level BPE a single space between two characters that are not white space always begins a new
    pre-token. So the text is cut at such spaces, and the ids of a chunk are remembered. Around other white space
    the text is not cut. Texts that spell a special token go through the tokenizer whole.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]
    encode = tiktoken_twin(path.removesuffix(".json") + ".tiktoken") or (lambda s: whole.encode(s, add_special_tokens=False).ids)
    ids = ChunkIds(encode)

    def run(text: str) -> bytes:
        if any(s in text for s in specials):
            return as_bytes(whole.encode(text, add_special_tokens=False).ids)
        if UNEVEN.search(text):
            first, rest = held_together(text)
        else:
            first, *rest = text.split(" ")
        return as_bytes(encode(first)) + b"".join(map(ids.__getitem__, rest))

    return run


#: Two white-space characters in a row, or white space at an end.
UNEVEN = re.compile(r"\s\s|^\s|\s\Z")


def held_together(text: str) -> tuple[str, list[str]]:
    """As text.split(" "), but without a cut at a space that has white space or an end beside it."""
    first, *parts = text.split(" ")
    out = [first]
    for p in parts:
        if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out[0], out[1:]


def tiktoken_twin(path: str) -> Callable[[str], list[int]] | None:
    """The same vocabulary as ranks, where its file lies beside: same ids, several times as fast."""
    import base64
    import os

    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenized(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """One row a piece. Documents longer than size are cut into pieces of size; the first is what is left over."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            own, rows = [], []
            for i, raw in enumerate(decoded(b.column(1))):
                doc = ids(raw) + end
                n, at = len(doc) // 4, 0
                for k in range(-(-n // size)):
                    length = (n - 1) % size + 1 if k == 0 else size
                    rows.append((k, at, length, zlib.crc32(doc[4 * at : 4 * (at + length)])))
                    own.append(i)
                    at += length
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col("text")).mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: tuple[float, float, float], rule: str = "dot") -> dict[int, list[tuple[int, int, int]]]:
    """Vector best-fit over counts of pieces by length, longest first.

    Returns for each length its runs (first rank, first sequence, offset): the pieces from that rank on go to
    consecutive sequences at that offset. Open bins that hold the same lengths are one class, split where only some of
    its bins take another piece. A piece that is over a capacity by itself has a bin of its own. Among the classes in which a piece fits in every dimension, "dot" takes the one with the greatest weighted dot product of demand and what would stay free, turned so that
    the tightest wins (weights: total demand over capacity), "norm" the one with the least norm of what stays free.
    """
    cap = np.asarray(capacity, float)
    total = np.zeros(3)
    for length, n in counts.items():
        total += n * np.array([length, 1, length**2])
    weight = total / cap / max(1e-300, (total / cap).sum())
    runs: dict[int, list[tuple[int, int, int]]] = {}
    free = np.zeros((0, 3))  # of each class
    many: list[int] = []  # bins in it
    first: list[int] = []
    offset: list[int] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length**2], float)
        left, rank, out = counts[length], 0, []
        score = None
        while left:
            fits = np.flatnonzero((free >= demand).all(axis=1)) if len(free) else []
            if len(fits):
                rest = (free[fits] - demand) / cap
                score = (rest * weight * (demand / cap)).sum(axis=1) if rule == "dot" else (weight * rest**2).sum(axis=1)
                k = int(fits[np.argmin(score)])
                n = min(left, many[k])
                out.append((rank, first[k], offset[k]))
                grown = (free[k] - demand, n, first[k], offset[k] + length)
                if n == many[k]:
                    free = np.delete(free, k, axis=0)
                    for x in (many, first, offset):
                        x.pop(k)
                else:
                    many[k] -= n
                    first[k] += n
            else:
                per = 1
                n = left
                if left > 1:  # a new bin takes as many of this length as fit, before another is opened
                    per = max(1, int(min(cap // demand)))
                    n = left // per if left >= per else 1
                    per = min(per, left)
                for j in range(per):
                    out.append((rank + j * n, opened, j * length))
                grown = (cap - per * demand, n, opened, per * length)
                opened += n
                n *= per
            rank, left = rank + n, left - n
            if grown[0][0] >= 1 and grown[0][1] >= 1 and grown[0][2] >= 1:
                same = np.flatnonzero((free == grown[0]).all(axis=1)) if len(free) else []
                merged = next((int(i) for i in same if offset[i] == grown[3] and first[i] + many[i] == grown[2]), None)
                if merged is None:
                    free = np.vstack([free, grown[0]])
                    many.append(grown[1])
                    first.append(grown[2])
                    offset.append(grown[3])
                else:
                    many[merged] += grown[1]
        runs[length] = out
    return runs


def packed(pieces: DataFrame, size: int = 1024, max_docs: int | None = None, max_attention: float | None = None, rule: str = "dot") -> DataFrame:
    """pieces (a table that reads the same each time: written) with sequence_id and offset.

    By default the two further capacities are as wide as the token capacity already implies, so that tokens alone
    decide how many sequences there are.
    """
    capacity = (float(size), float(max_docs or size), float(max_attention or size**2))
    placed = pieces.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counted = written(placed, "pieces")
    per_task = counted.groupBy("_task", "length").count()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most size rows
    runs = plan({int(k): int(v) for k, v in counts.items()}, capacity, rule)
    return placed_by_rank(counted, per_task, runs)


def placed_by_rank(counted: DataFrame, per_task: DataFrame, runs: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """Joins each piece to the run its rank lies in. A rank is the count in earlier tasks plus that in its own."""
    from pyspark.sql import Window

    before = per_task.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("_task", "length", F.coalesce("_before", F.lit(0)).alias("_before"))
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}
    names = [c for c in counted.columns if c not in ("_task", "_at")]
    rows = counted.join(before, ["_task", "length"]).repartition("_task").sortWithinPartitions("_task", "_at").select("_task", "_before", *names)
    where = {c: i + 2 for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        at_task = None
        for b in batches:
            task = b.column(0).to_numpy()
            length = b.column(where["length"]).to_numpy()
            before = b.column(1).to_numpy()
            seq, off = np.empty(len(task), np.int64), np.empty(len(task), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)] if len(task) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if task[lo] != at_task:
                    at_task, seen = task[lo], {}
                part = length[lo:hi]
                order = np.argsort(part, kind="stable")
                kinds, starts, n = np.unique(part[order], return_index=True, return_counts=True)
                for kind, s, m in zip(kinds.tolist(), starts.tolist(), n.tolist(), strict=True):
                    own = order[s : s + m] + lo
                    rank = before[own] + seen.get(kind, 0) + np.arange(m)
                    seen[kind] = seen.get(kind, 0) + m
                    ranks, seqs, offs = tables[kind]
                    k = np.searchsorted(ranks, rank, side="right") - 1
                    seq[own], off[own] = seqs[k] + rank - ranks[k], offs[k]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", **limits) -> DataFrame:
    """One row a piece of every document, with its place in a sequence.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Further columns of docs are not read.
    """
    return packed(tokenized(docs, path, size, id_col), size, **limits)
