"""Quotation linking: reply-ordered conversations without quotes.

A line that begins with `>` marks is quoted, as deep as it has marks. Quoted lines of one depth up to an empty line
are a passage. A passage and each of its lines is normalised (marks off, lower case, white space folded) and hashed,
as are the paragraphs and lines that messages write themselves. A quoted unit is joined to the earliest message of
its conversation that wrote it. A message replies to the message that most of its shallowest linked quotes come
from; threads follow from the replies by pointer doubling.

Originals are aggregated to one row a unit before the join, so a passage that many messages share makes no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import decoded, key_col, written

MARKS = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
_UNITS = "conv long, turn long, level int, h long, chars int"


def turn_of(key: str) -> F.Column:
    return F.when(F.col(key) != -(2**63), F.col(key))


def split_levels(text: str) -> list[tuple[int, str]]:
    """(depth of quotation, line without marks) of every line."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def units(text: str) -> list[tuple[int, str]]:
    """(depth, normalised text) of every paragraph or passage and of each of its lines; empty ones are none."""
    out, held, at = [], [], 0
    for level, line in [*split_levels(text), (-1, "")]:
        line = normal(line)
        if level != at or not line:
            if len(held) > 1:
                out.append((at, " ".join(held)))
            held, at = [], level
        if line:
            held.append(line)
            out.append((level, line))
    return out


def unquoted(text: str) -> str:
    """What the message itself says; empty lines at its ends are dropped."""
    return "\n".join(line for level, line in split_levels(text) if level == 0).strip("\n")


def unit_rows(messages: DataFrame) -> DataFrame:
    """A row for each unit of a message: conv, turn, level, hash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, turn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), decoded(b.column(2)), strict=True):
                for level, unit in dict.fromkeys(units(text)):
                    h = xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"))
                    rows.append((conv, turn, level, h - 2**64 if h >= 2**63 else h, len(unit)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv", "turn", "level", "h", "chars"])

    return messages.select(key_col("conv_id").alias("conv"), key_col("turn").alias("turn"), "text").mapInArrow(run, _UNITS)


def reply_links(messages: DataFrame) -> DataFrame:
    """conv, turn, parent, n_linked: the message that each linked message replies to, and how many of its quoted units are linked."""
    found = written(unit_rows(messages), "quote-units")
    first = found.where("level = 0").groupBy("conv", "h").agg(F.min("turn").alias("origin"))
    quoted = found.where("level > 0").groupBy("conv", "turn", "h").agg(F.min("level").alias("level"), F.max("chars").alias("chars"))
    linked = quoted.join(first, ["conv", "h"]).where("origin < turn")
    votes = linked.groupBy("conv", "turn", "level", "origin").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.max_by("origin", F.struct(-F.col("level"), "chars", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("parent"), F.sum("n").alias("n_linked"))


def threads(replies: DataFrame, rounds: int = 64) -> DataFrame:
    """conv, turn, root, depth of each message that replies to another. Each round doubles the way that a pointer has come."""
    now = written(replies.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    for _ in range(rounds):
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        far = now.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        moved = written(far.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return now


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, reply_to, root, depth, n_linked and n_quoted_lines of every row.

    Ordered by conv_id, root, depth and turn, every message comes after the one it replies to. A message that quotes
    nothing that was written before in its conversation is the root of a thread: reply_to is null, root its own turn,
    depth 0. Null texts stay null. Rows of one conv_id and turn count as one message, and each is returned. Null ids and turns are a
    conversation and a (first) turn of their own. An empty table gives an empty result. Other columns are not read.
    """
    replies = written(reply_links(messages), "replies")
    tree = replies.join(threads(replies), ["conv", "turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = decoded(b.column("text"))
            quoted = [sum(level > 0 for level, _ in split_levels(t)) for t in texts]
            own = [unquoted(t) if ok else None for t, ok in zip(texts, b.column("text").is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.string()), pa.array(quoted, pa.int32())], names=[*b.schema.names, "n_quoted_lines"])

    kinds = dict(messages.dtypes)
    rows = messages.select("conv_id", F.col("turn").alias("own_turn"), key_col("conv_id").alias("conv"), key_col("turn").alias("turn"), "role", "text")
    rows = rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, own_turn {kinds['turn']}, conv long, turn long, role string, text string, n_quoted_lines int")
    out = rows.join(tree, ["conv", "turn"], "left")
    return out.select(
        "conv_id", F.col("own_turn").alias("turn"), "role", "text", turn_of("parent").alias("reply_to"),
        turn_of("root").alias("root_linked"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "n_quoted_lines",
    ).withColumn("root", F.coalesce("root_linked", "turn")).drop("root_linked")


def quoting(messages: DataFrame) -> DataFrame:
    """Messages as mail programs send them: two of three replies quote the first line of the message before, every third one also that of the one before that, a level deeper.

    conv_id, turn, role, text. A conversation is sorted by turn; only first lines of its messages go with that.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    each = messages.select("conv_id", "turn", "role", "text", F.lag(line, 1).over(w).alias("_one"), F.lag(line, 2).over(w).alias("_two"))
    deep = F.when((F.col("turn") % 3 == 2) & F.col("_two").isNotNull(), F.concat(F.lit("> > "), "_two", F.lit("\n"))).otherwise("")
    quote = F.when((F.col("turn") % 3 > 0) & F.col("_one").isNotNull(), F.concat(deep, F.lit("> "), "_one", F.lit("\n\n"))).otherwise("")
    return each.select("conv_id", "turn", "role", F.concat(quote, "text").alias("text"))


#: Of quoting() the quoted lines are known, so only their origins are looked for: the first message with such a line.
SQL = """
with m as (select conv_id, turn, role, text, lag(split_part(text, chr(10), 1)) over w as one, lag(split_part(text, chr(10), 1), 2) over w as two from conversations window w as (partition by conv_id order by turn)),
q as (select *, turn % 3 > 0 and one is not null as quotes, turn % 3 = 2 and two is not null as deep from m),
own as (select conv_id, turn, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g')) as unit from m),
first_ as (select conv_id, unit, min(turn) as origin from own where unit <> '' group by all),
asked as (select conv_id, turn, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) as unit, min(level) as level from (select conv_id, turn, 1 as level, one as line from q where quotes union all select conv_id, turn, 2, two from q where deep) group by all),
links as (select a.conv_id, a.turn, level, origin, length(unit) as chars from asked a join first_ f using (conv_id, unit) where origin < a.turn),
votes as (select conv_id, turn, level, origin, sum(chars) as chars, count(*) as n from links group by all),
replies as (select conv_id, turn, first(origin order by level, chars desc, origin desc) as parent, sum(n) as n from votes group by all),
up as (with recursive t(conv_id, turn, root, depth) as (select conv_id, turn, parent, 1 from replies union all select t.conv_id, t.turn, r.parent, depth + 1 from t join replies r on r.conv_id = t.conv_id and r.turn = t.root) select conv_id, turn, first(root order by depth desc) as root, max(depth) as depth from t group by all)
select q.conv_id, q.turn, q.role, trim(q.text, chr(10)) as text, r.parent::bigint as reply_to, coalesce(u.root, q.turn)::bigint as root, coalesce(u.depth, 0)::int as depth, coalesce(r.n, 0)::bigint as n_linked, (quotes::int + deep::int)::int as n_quoted_lines
from q left join replies r on r.conv_id = q.conv_id and r.turn = q.turn left join up u on u.conv_id = q.conv_id and u.turn = q.turn
"""
