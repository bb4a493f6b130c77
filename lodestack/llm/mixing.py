"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, stopped at three times the source's own size. A document
is due target / source_size copies on average, more if it is longer and fewer if it is shorter than its source's
mean, so that the copies due, weighted by size, make the target. The whole part of what is due is certain; the
fraction is the document's probability of inclusion in a sample without repeats. Documents are ranked by the odds
of a random number divided by the odds of their inclusion, and the first are taken until the sample's size in
words is as near the rest as whole documents allow; a long document at the border is passed over once. Random
numbers are digests of doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import pin, running_totals, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
#: Copies due differ from their mean by a quarter of what is possible at most for twice GRAIN; whole numbers, so that sums are exact.
GRAIN, ROOM = 512, 0.25
#: Rows of per-source tables (some 60 bytes each) sent to all tasks; more are joined by a shuffle.
SOURCES_SENT = 100_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` -> rank, target and what follows from it, one row per source.

    Caps are found in one pass: in order of cap over weight, a source is capped if the level that the
    earlier caps leave would lift it above its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") % len(WEIGHTS)) + 1).cast("int"))
    ranked = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).withColumn("w", w.cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("left", left).withColumn("level", F.col("left") / weight)
    leveled = leveled.withColumn("capped", F.col("cap") < F.col("w") * F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("w"), -F.col("rank"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * final))
    out = leveled.withColumn("target", target)
    return out.select("source", "rank", "source_size", "target")


def pareto_key(doc_id: Column, inclusion: Column) -> Column:
    """Odds of a random number over odds of inclusion; 52 bits of a digest make the number, never 0 or 1."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double")
    u = (h + 0.5) / float(1 << 52)
    return (u / (1.0 - u)) / (inclusion / (1.0 - inclusion))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SOURCES_SENT else table


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep`` columns, source, size, source_size, target, taken, copies per row of ``docs(doc_id, text, source)``.

    A null text has size 0 and is never short of or over its target. Null source is a source, the last.
    Rows with equal doc_id, source and size are interchangeable; null doc_ids share one random number.
    """
    keep = keep or []
    rows = pin(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), *keep))
    sizes = pin(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("texts")))
    targets = source_targets(sizes.select("source", "source_size")).join(
        sizes.select(F.col("source").alias("t_source"), F.expr("source_size div texts").alias("mean")), F.col("source").eqNullSafe(F.col("t_source"))
    )
    targets = pin(targets.select("t_source", "rank", "source_size", "target", "mean"))
    joined = rows.join(_small(targets), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    joined = joined.withColumn("grade", F.expr(f"({2 * GRAIN} * size) div greatest(size + mean, 1)")).drop("mean")
    middle = joined.groupBy("rank").agg(F.expr("sum(size * grade) div greatest(first(source_size), 1)").alias("middle"))
    joined = joined.join(_small(pin(middle)), "rank")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    room = F.least(due, F.lit(float(MOST)) - due) * F.lit(ROOM)
    due = due + room * ((F.col("grade") - F.col("middle")) / F.lit(float(GRAIN)))
    joined = joined.withColumn("due", due).withColumn("whole", F.least(F.greatest(F.floor("due"), F.lit(0)), F.lit(MOST)).cast("long"))
    certain = joined.groupBy("rank").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    joined = joined.join(_small(pin(certain)), "rank").withColumn("rest", F.col("target") - F.col("certain"))
    # A share of nought or one is certain; the odds are those of a share between.
    share = F.least(F.greatest(F.col("due") - F.col("whole"), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    joined = joined.withColumn("q", pareto_key(F.col("doc_id"), share)).drop("grade", "middle", "due", "certain")
    ranked = pin(running_totals(joined, ["rank"], ["q", "doc_id", "size", *keep], "size", "before"))
    near = lambda before: (F.col("rest") > 0) & (F.col("whole") < MOST) & (2 * before + F.col("size") <= 2 * F.col("rest"))
    border = ranked.where((F.col("size") > 0) & (F.col("before") < F.col("rest")) & ~near(F.col("before"))).groupBy("rank")
    border = pin(border.agg(F.min("before").alias("passed"), F.min_by("size", "before").alias("over")))
    ranked = ranked.join(_small(border), "rank", "left")
    behind = F.coalesce(F.col("before") >= F.col("passed") + F.col("over"), F.lit(False))
    drawn = (near(F.col("before")) | (behind & near(F.col("before") - F.col("over")))).cast("long")
    out = ranked.withColumn("copies", F.col("whole") + drawn).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", *keep, "source", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to 3 times), all columns kept, whatever their names."""
    whole = docs.select("doc_id", "text", "source", F.xxhash64(text_or_empty()).alias("_mx_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    taken = mix(whole.select("doc_id", "text", "source", "_mx_hash"), ["_mx_hash"])
    # Equal rows share what they are given, so that the join meets each row once.
    per_key = taken.groupBy("doc_id", "source", "_mx_hash").agg(F.sum("copies").alias("_mx_copies"), F.count("*").alias("_mx_rows"))
    per_key = pin(per_key.where("_mx_copies > 0")).select(F.col("doc_id").alias("_mx_id"), F.col("source").alias("_mx_source"), F.col("_mx_hash").alias("_mx_h"), "_mx_copies", "_mx_rows")
    same = F.col("doc_id").eqNullSafe(F.col("_mx_id")) & F.col("source").eqNullSafe(F.col("_mx_source")) & (F.col("_mx_hash") == F.col("_mx_h"))
    met = whole.select("doc_id", "source", "_mx_hash", "_row").join(per_key, same)
    single = met.where("_mx_rows = 1")
    many = met.where("_mx_rows > 1").dropDuplicates(["_mx_id", "_mx_source", "_mx_h"])
    copied = single.unionByName(many).withColumn("_mx_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mx_copies"))))
    return copied.select("_row.*")


def op8_query(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = rf"""
with d as (select doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text,'[\x20\x09-\x0D]+'), lambda x: x<>'')),0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, (row_number() over (order by source nulls last) - 1) as rank from s),
k as (select *, (case rank % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w, 3.0::double * source_size as cap from r),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap/w, rank rows between unbounded preceding and 1 preceding), 0.0::double))
  / (sum(w) over () - coalesce(sum(w) over (order by cap/w, rank rows between unbounded preceding and 1 preceding), 0.0::double)) as level from k),
c as (select *, cap < w*level as capped from l),
f as (select *, arg_min(level, (cap/w, rank)) filter (not capped) over () as final from c),
t as (select *, case when capped then cap else least(cap, w*final) end as target from f),
n as (select source, count(*) as texts from d group by source),
g as (select t.*, t.source_size // texts as mean from t join n on t.source is not distinct from n.source),
h as (select d.doc_id, d.size, g.source_size, g.target, d.source, g.rank, ({2 * GRAIN} * d.size) // greatest(d.size + g.mean, 1) as grade,
  (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar,'null')),1,13))::bigint::double + 0.5)/{float(1 << 52)!r}::double as u
  from d join g on d.source is not distinct from g.source),
m as (select *, (sum(size * grade) over (partition by rank) // greatest(source_size, 1))::bigint as middle,
  case when source_size > 0 then target / source_size else 0.0::double end as mean_due from h),
e as (select *, mean_due + (least(mean_due, {float(MOST)!r}::double - mean_due) * {ROOM!r}::double) * ((grade - middle) / {float(GRAIN)!r}::double) as due from m),
w as (select *, least(greatest(floor(due), 0), {MOST})::bigint as whole from e),
p as (select *, target - sum(whole * size) over (partition by rank) as rest, least(greatest(due - whole, 1e-12::double), 1.0::double - 1e-12::double) as pi from w),
o as (select *, (u/(1.0::double-u)) / (pi/(1.0::double-pi)) as q from p),
b as (select *, coalesce(sum(size) over (partition by rank order by q, doc_id nulls first, size rows between unbounded preceding and 1 preceding),0) as before from o),
x as (select *, rest > 0 and whole < {MOST} and 2*before + size <= 2*rest as near from b),
v as (select rank, min(before) as passed, arg_min(size, before) as over_ from x where size > 0 and before < rest and not near group by rank),
z as (select x.*, whole + (case when near or (coalesce(before >= passed + over_, false) and rest > 0 and whole < {MOST} and 2*(before-over_) + size <= 2*rest) then 1 else 0 end) as copies from x left join v on x.rank = v.rank)
select doc_id, size, source_size, target, (copies*size)::bigint as taken, source, copies::bigint as copies from z"""
