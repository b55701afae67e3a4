"""SimHash near-duplicate groups by pivot distance tables.

Every fingerprint gets its Hamming distances to many reference fingerprints, the pivots, once. They serve three times:

Candidates. The 64 bits are cut into groups; inside a group every two neighbouring bits are a pivot with only these
two bits set. From the distances to zero and to such a pivot follows how many of the two bits are set: their relative
coordinate. A bit that differs changes coordinates of its own group only, so fingerprints within RADIUS bits agree in
all coordinates of at least GROUPS - RADIUS groups: they meet in the bucket of one choice of that many groups. No
link is lost.

Discarding. By the triangle inequality two fingerprints within the radius differ by at most the radius in their
distance to any pivot. Of pairs that meet, those with a greater difference from one of SCATTERED pivots, which cut
across the groups, are discarded without a look at their bits.

Verifying. The survivors' bits are counted (and their texts compared, where a likeness of texts is asked for).

In each bucket all members first meet the least and the greatest of them only. Buckets whose members lie in one component by then are
done; only in the others members of different components meet each other. So a dense group makes a star, not all
pairs, and no link between components is lost. Equal fingerprints are one before. Components come from star
contraction over written tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm import jaccard
from lodestat.llm.common import discard, key_col, numbered, raw_texts, renamed, text_key, word_runs, written
from lodestat.llm.common import mixed as scrambled

SEED = 42
RADIUS = 4
GROUPS = 7
SCATTERED = 14
#: Distances in a long, a byte each, so that all of them are compared at once.
PACKED = 7


def simhash(raw: bytes, k: int = 4) -> int:
    """Of a whole text: A-Z lowered, k-word shingles with repeats, a bit set where over half of the hashes have it.

    With fewer than k words the whole sequence is the one shingle; without words the fingerprint is 0.
    """
    digest = xxhash.xxh64_intdigest
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for words in word_runs(raw.lower()):
        words = carry + words
        if len(words) >= k:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size).tolist()
            found = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], "<u8")
            ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(found)
        carry = words[-(k - 1) :] if k > 1 else []
    if n == 0:
        if not carry:
            return 0
        return digest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def word_set_simhashes(raw: bytes) -> tuple[int, int]:
    """Two of the distinct words of a whole text, A-Z lowered: changes of a few words move few bits. Without words 0.

    The second takes a scramble of the hashes of the first, so that its bits err independently of those.
    """
    digest = xxhash.xxh64_intdigest
    found: set[bytes] = set()
    for words in word_runs(raw.lower()):
        found.update(words)
    if not found:
        return 0, 0
    each = np.fromiter((digest(w, SEED) for w in found), "<u8", len(found))
    return majority(each), majority(scrambled(each))


def majority(each: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(each), 1 << 16):
        ones += np.unpackbits(each[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(each), bitorder="little").view("<u8")[0])


def with_simhash(docs: DataFrame, of: Callable[[bytes], int] = simhash, id_col: str = "doc_id") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([of(t) for t in raw_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {kind}, fp long")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def grouped_pivots(groups: int = GROUPS) -> list[list[int]]:
    """For each group of bits its pivots: every two neighbouring bits of it."""
    edges = [round(64 * i / groups) for i in range(groups + 1)]
    return [[signed(3 << k) for k in range(a, b - 1)] for a, b in itertools.pairwise(edges)]


def scattered_pivots(n: int = SCATTERED) -> list[int]:
    """Hashes of the numbers from 0, fixed for all data."""
    return [signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED)) for i in range(n)]


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot)))


def distance_table(nodes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """nodes(node, fp, ...) with g, the relative coordinates of each group, and d, the distances to the scattered pivots.

    Both are packed into longs: two bits a relative coordinate, a byte a distance.
    """
    fp = F.col("fp")
    packed = lambda parts, bits: sum((F.shiftleft(x.cast("long"), bits * i) for i, x in enumerate(parts)), F.lit(0).cast("long"))
    relative = lambda p: F.shiftright(distance(fp, 0) + 2 - distance(fp, p), 1)
    g = F.array(*(packed(map(relative, own), 2) for own in grouped_pivots(groups)))
    far = [distance(fp, p) for p in scattered_pivots()]
    others = [c for c in nodes.columns if c not in ("node", "fp")]
    return nodes.select("node", "fp", *others, g.alias("g"), F.struct(*(packed(far[i : i + PACKED], 8).alias(f"d{i // PACKED}") for i in range(0, len(far), PACKED))).alias("d"))


def buckets(table: DataFrame, groups: int = GROUPS, alike: int = GROUPS - RADIUS) -> DataFrame:
    """b, node: a row for each choice of groups that are to be alike. A chance meeting in b costs a look, no more."""
    chosen = itertools.combinations(range(groups), alike)
    return table.select("node", F.explode(F.array(*(F.xxhash64(F.lit(t), *(F.col("g")[i] for i in c)) for t, c in enumerate(chosen)))).alias("b"))


def not_discarded(a: str, b: str, radius: int) -> Column:
    """No distance to a scattered pivot differs by more than the radius.

    All bytes of a long at once: 128 + x - y + radius keeps its high bit if and only if x - y is at least -radius.
    """
    ones = sum(1 << (8 * i) for i in range(PACKED))
    high, slack = F.lit(128 * ones), F.lit(radius * ones)
    out = F.lit(True)
    for i in range(-(-SCATTERED // PACKED)):
        x, y = F.col(f"{a}.d.d{i}"), F.col(f"{b}.d.d{i}")
        down, up = x.bitwiseOR(high) - y + slack, y.bitwiseOR(high) - x + slack
        out = out & (down.bitwiseAND(up).bitwiseAND(high) == high)
    return out


def verified(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius


def near(pairs: DataFrame, table: DataFrame, radius: int, may: Callable[[str, str], Column]) -> DataFrame:
    """The pairs(a, b) of nodes that the pivots don't discard and that are within the radius.

    Pairs come from an explode, whose rows the planner does not count: merge hints keep them from being broadcast.
    """
    x, y = table.drop("g").alias("x").hint("merge"), table.drop("g").alias("y").hint("merge")
    met = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return met.where(not_discarded("x", "y", radius) & verified("x", "y", radius) & may("x", "y")).select("a", "b")


def linked(
    nodes: DataFrame, radius: int = RADIUS, groups: int = GROUPS, alike: int | None = None,
    may: Callable[[str, str], Column] = lambda a, b: F.lit(True), same: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    known: DataFrame | None = None,
) -> DataFrame:
    """node, root for every node of nodes(node, fp, ...) that is not alone and not the root (least node) of its component.

    alike: groups in which a pair agrees to become a candidate; by default as many as lose none. may: what two rows of
    nodes must fulfil besides; same: keeps of pairs(a, b) those that are links. By default all within the radius are.
    known: links(a, b) found before; the components are those of old and new ones.
    """
    table = written(distance_table(nodes, groups), "simhash-table")
    each = buckets(table, groups, alike or groups - radius)
    met = each.groupBy("b").agg(F.count("*").alias("c"), F.min("node").alias("least"), F.max("node").alias("most")).where("c > 1").drop("c")
    # the planner takes the exploded rows for as few as there are nodes
    shared = written(each.join(met.hint("merge"), "b"), "simhash-buckets")

    pair = lambda u, v: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    stars = shared.select(F.explode(F.array(pair("least", "node"), pair("node", "most"))).alias("p")).select("p.a", "p.b").where("a < b").distinct()
    stars = written(same(written(near(stars, table, radius, may), "simhash-stars")), "simhash-links")
    if known is not None:
        stars = stars.unionByName(known)
    root = components(stars).withColumnRenamed("root", "own")
    at = shared.join(root, "node", "left").select("b", "node", F.coalesce("own", "node").alias("root"))
    at = written(at, "simhash-rooted")
    mixed = at.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("b")
    rest = written(at.join(mixed, "b", "left_semi").join(table.drop("g"), "node"), "simhash-rest")
    x, y = rest.alias("x"), rest.alias("y")
    on = (F.col("x.b") == F.col("y.b")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    pairs = x.join(y, on & not_discarded("x", "y", radius) & verified("x", "y", radius) & may("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = written(same(written(pairs, "simhash-pairs")), "simhash-links")
    return components(stars.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b) that is not its own root.

    Alternates large-star and small-star steps: every node hands its greater, then its smaller neighbours to the
    least of its neighbourhood, until nothing changes. Minima are aggregated before they are shuffled. A round's
    table is dropped once the next is written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    was = fixed(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, "edges")
        discard(now, large)
        now, before, was = small, was, fixed(small)
        if was == before:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def fixed(edges: DataFrame) -> tuple:
    """A digest of a set of edges that does not depend on their order."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def near_groups(docs: DataFrame, k: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    component_id is the least doc_id that a row reaches over links, its own included. A null or empty text has the
    fingerprint zero and is linked like any other. Repeated rows share a component. Null ids take part as the
    greatest of all; a component of them alone has a null id. An empty table gives an empty result. Other columns
    are not read.
    """
    prints = written(with_simhash(docs, lambda raw: simhash(raw, k)), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    root = linked(distinct.select(F.col("fp").alias("node"), "fp"), radius, radius + GROUPS - RADIUS)
    # the roots of fingerprints, then the least id of each root
    of = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = of.join(least, "root").select("fp", "component_id")
    return prints.join(table, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_rows(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of every component of texts, all columns as they were.

    roots has the root of every node (text_key of a text) that is not its own. The row with the least doc_id stays,
    null ids last; among rows of one id that with the least text_key, then the least of the other columns. Only rows
    of one component ever give way to each other, whatever their ids. The texts are shuffled once, to meet the choice.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.md5(F.to_json(F.struct(*others)).cast("binary")) if others else F.lit("")
    rows = docs.select(*numbered(docs), F.col("doc_id").isNull().alias("_none"), key_col("doc_id").alias("_key"), text_key("text").alias("_node"), rest.alias("_rest"))
    choice = rows.select("_none", "_key", "_node", "_rest").join(roots, F.col("_node") == F.col("node"), "left")
    first = choice.groupBy(F.coalesce("root", "_node").alias("root")).agg(F.min(F.struct("_none", "_key", "_node", "_rest")).alias("first")).select("first.*")
    by = ["_none", "_key", "_node", "_rest"]
    return renamed(rows.join(first, by, "left_semi").dropDuplicates(by), docs.columns)


def one_of_each(docs: DataFrame, radius: int = 10, groups: int = 8, alike: int = 3, k: int = 5) -> DataFrame:
    """One row of every group of texts that are linked, all columns as they were; see least_rows.

    Texts are linked whose sets of k-word shingles have a Jaccard similarity of at least jaccard.LEAST, verified on
    the whole sets, among those of which one of the two word_set_simhashes lies within the radius and agrees in so many
    groups. Within groups - alike bits no pair is missed; beyond, a pair agrees in that many groups with a probability
    that falls with its distance, for each of the two anew. Texts that are equal up to the case of A-Z and white space
    are candidates always. A null text counts as empty; empty texts are alike. An empty table gives an empty result.
    """
    texts = docs.select(text_key("text").alias("name"), "text")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_texts(b.column(1))
            sets = [jaccard.shingles(t, k) for t in raw]
            prints = np.array([word_set_simhashes(t) for t in raw], np.uint64).reshape(-1, 2).view(np.int64)
            both = [pa.array(np.ascontiguousarray(c)) for c in prints.T]
            yield pa.RecordBatch.from_arrays([b.column(0), *both, pa.array(map(len, sets), pa.int32()), jaccard.bitmaps(sets)], names=["name", "fp", "other", "n", "bits"])

    prints = texts.mapInArrow(facts, f"name string, fp long, other long, {jaccard.FACTS}").dropDuplicates(["name"])
    prints = written(prints.withColumn("node", F.monotonically_increasing_id()), "simhash")
    names = prints.select("node", "name")
    same = lambda pairs: jaccard.similar_pairs(pairs, texts, names, k)
    first = written(linked(prints.drop("name", "other"), radius, groups, alike, jaccard.may_be_similar, same), "simhash-roots")
    # by the other fingerprint only what the first left apart is compared
    own = prints.join(first, "node", "left").select("node", F.col("other").alias("fp"), "n", "bits", F.coalesce("root", "node").alias("own"))
    may = lambda a, b: (F.col(f"{a}.own") != F.col(f"{b}.own")) & jaccard.may_be_similar(a, b)
    root = linked(own, radius, groups, alike, may, same, first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = names.select(F.col("node").alias("root"), F.col("name").alias("root_name"))
    return least_rows(docs, root.join(names, "node").join(of, "root").select(F.col("name").alias("node"), F.col("root_name").alias("root")))
