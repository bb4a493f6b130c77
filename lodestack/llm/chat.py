"""Chat formatting of logged conversations after collapsing cumulative snapshots.

A service that logs a conversation after every turn leaves many snapshots, each a prefix of the next.
Rolling hashes over position, role and text give every turn a hash of the conversation up to it. A
conversation is a snapshot if another one passes through its last hash and goes on; those are removed by an
anti-join, of equal conversations the least id stays, and the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import pin, running_totals

#: Turns of a rendered part; a longer conversation is rendered in several rows.
PART_TURNS = 256
_BITS = (1 << 40) - 1
_NO_ID = -(1 << 63)


def _rendered(role: Column, text: Column) -> Column:
    """One turn. Markers inside a text are broken up, so that only the template makes turns."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds k (position from 1) and p1, p2, the rolling hash of the conversation up to the turn, to (conv, turn, role, text)."""
    numbered = running_totals(turns.withColumn("one", F.lit(1).cast("long")), ["conv"], ["turn", "role", "text"], "one", "before").drop("one")
    at = numbered.withColumn("k", F.col("before") + 1).drop("before")
    parts = [F.col("k"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    hashed = at.withColumn("h1", F.xxhash64(*parts).bitwiseAND(F.lit(_BITS))).withColumn("h2", F.xxhash64(F.lit("second"), *reversed(parts)).bitwiseAND(F.lit(_BITS)))
    rolled = running_totals(hashed, ["conv"], ["k"], ["h1", "h2"], ["b1", "b2"])
    return rolled.withColumn("p1", F.col("b1") + F.col("h1")).withColumn("p2", F.col("b2") + F.col("h2")).drop("b1", "b2", "h1", "h2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv, copies): the least id of every conversation that is not a proper prefix of another; how many equal ones there were."""
    ends = hashed.groupBy("conv").agg(F.max_by(F.struct("k", "p1", "p2"), "k").alias("e"))
    finals = pin(ends.groupBy(F.col("e.k").alias("k"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2")).agg(F.min("conv").alias("conv"), F.count("*").alias("copies")))
    passing = hashed.groupBy("k", "p1", "p2").agg(F.count("*").alias("seen"))
    # More turns bear the hash than conversations end there: some go on.
    longer = passing.join(finals.select("k", "p1", "p2", "copies"), ["k", "p1", "p2"]).where("seen > copies").select("k", "p1", "p2")
    return finals.join(longer, ["k", "p1", "p2"], "left_anti").select("conv", "copies", F.col("k").alias("n_turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, text per part of each maximal conversation of ``(conv_id, turn, role, text)``.

    Turns go by turn, then role and text; repeated turns stay. A null turn comes first; a null role is
    rendered as unknown, a null text as empty, and neither equals a given one. Turns with a null conv_id are
    one conversation. An empty table gives no rows; other columns are not read.
    """
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hashed = pin(prefix_hashes(turns))
    kept = pin(maximal_conversations(hashed))
    rows = hashed.join(kept, "conv").withColumn("part", F.floor((F.col("k") - 1) / PART_TURNS).cast("long"))
    one = F.struct("k", _rendered(F.col("role"), F.col("text")).alias("t"))
    parts = rows.groupBy("conv", "part").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(one)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["t"]), "")
    return parts.select(F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"), "part", "n_turns", "copies", text.alias("text"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = rf"""
with c as (select coalesce(conv_id, {_NO_ID}) as conv, turn, role, text from conversations),
r as (select *, row_number() over w as k, count(*) over (partition by conv) as n,
 string_agg(coalesce(length(role)::varchar,'null') || ':' || coalesce(role,'') || coalesce(length(text)::varchar,'null') || ':' || coalesce(text,''), '')
  over (partition by conv order by turn nulls first, role nulls first, text nulls first rows between unbounded preceding and current row) as prefix
 from c window w as (partition by conv order by turn nulls first, role nulls first, text nulls first)),
f as (select k, prefix, min(conv) as conv, count(*) as copies from r where k = n group by k, prefix),
m as (select * from f where not exists (select 1 from r where r.k = f.k and r.prefix = f.prefix and r.n > r.k))
select case when m.conv <> {_NO_ID} then m.conv end as conv_id, ((r.k-1)//{PART_TURNS})::bigint as part, m.k as n_turns, m.copies,
 string_agg('<|im_start|>' || coalesce(role,'unknown') || chr(10) || regexp_replace(coalesce(text,''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') || '<|im_end|>' || chr(10), '' order by r.k) as text
from r join m on r.conv = m.conv group by all"""
