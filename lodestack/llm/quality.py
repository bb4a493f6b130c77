"""Adaptive quality rules: thresholds from mergeable quantile sketches instead of fixed cutoffs.

DataFrame functions only. Every text gets integer measures; measures of texts that pass the base rules are
counted into log-linear buckets (five significant bits, so a quantile is off by at most 1/32). A sketch is
the counts per bucket: sketches of (language, source) add up to those of a language and of the corpus. A
group's fences lie ``SPREAD`` interquartile ranges outside its quartiles. Quartiles of small groups are unsure, so
they are blended: a group's with its language's, as if that were ``PRIOR`` more texts, the language's with the
corpus's in the same way. The blend moves with the number of texts and knows no step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import WS_CHARS, pin, text_or_empty

SYMBOLS = "#*$%&|<>"
SPREAD, PRIOR = 6, 100
#: Fences of up to so many groups (some 200 bytes each) are sent to all tasks; more are joined by a shuffle.
FENCES_SENT = 20_000
#: Measure -> least interquartile range that counts. word_len: code points in 100 words; the rest: in 1000 words.
MEASURES = {"word_len": 20, "symbols": 10, "dup_lines": 4, "repeats": 25}
#: Only the length of words has a lower fence.
TWO_SIDED = {"word_len"}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column, width: int) -> Column:
    """Positions inside windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p"))))

    def starts(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1),
            lambda y, x: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])).otherwise(F.array().cast("array<int>")),
        )
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def total(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(width), b - a))
        return F.aggregate(gaps, F.lit(width), lambda acc, g: acc + g)

    return _let(_let(ordered, starts), lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(total(p)))


def _repeat_words(words: Column, width: int = 8) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    seen = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, width)).otherwise(F.lit(0)))
    return F.when(n < width + 1, F.lit(0)).otherwise(seen)


def base_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus _q, a struct of the contract's counts. A null text has no word and no line."""
    text = text_or_empty()
    spaced = F.translate(text, WS_CHARS, " " * len(WS_CHARS))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WS_CHARS, "")) > 0)
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select(
        *keep, counts.alias("_c"), F.length(F.translate(text, WS_CHARS, "")).cast("long").alias("_wc"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("_ns"), dup.alias("_nd"),
    )
    n, rep = F.col("_c.n_words"), F.col("_c.n_repeat_words")
    failed = (n < 20) | (100 * rep > 30 * n)
    packed = F.struct(
        n.alias("n_words"), F.col("_wc").alias("word_chars"), F.col("_ns").alias("n_symbols"), F.col("_nd").alias("n_dup_lines"),
        rep.alias("n_repeat_words"), failed.alias("base_failed"),
    )
    # A generator is a barrier: what reads _q later, above all a filter, does not measure the text again.
    return out.select(*keep, F.explode(F.array(packed)).alias("_q"))


def _measure(name: str) -> Column:
    top = {"word_len": 100 * F.col("_q.word_chars"), "symbols": 1000 * F.col("_q.n_symbols"), "dup_lines": 1000 * F.col("_q.n_dup_lines"), "repeats": 1000 * F.col("_q.n_repeat_words")}[name]
    return F.floor(top / F.greatest(F.col("_q.n_words"), F.lit(1)))


def bucket(value: Column) -> Column:
    """Lower bound of the log-linear bucket: the value with all but its leading six bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the texts that pass the base rules."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(_measure(m)).alias("bucket")) for m in MEASURES)))
    rows = measured.where(~F.col("_q.base_failed")).select("lang", "source", cells.alias("c"))
    return rows.groupBy("lang", "source", F.col("c.measure").alias("measure"), F.col("c.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def fences(cells: DataFrame) -> DataFrame:
    """Per (lang, source) of the sketch: lo_m and hi_m of every measure, from quartiles blended over the levels."""
    levels = []
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        merged = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure").orderBy("bucket")
        ranked = merged.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "measure")))
        q = ranked.groupBy(*keys).agg(
            F.max("all").alias(f"texts_{level}"),
            *(
                F.min(F.when((F.col("measure") == m) & (4 * F.col("cum") >= k * F.col("all")), F.col("bucket"))).alias(f"q{k}_{m}_{level}")
                for m in MEASURES for k in (1, 3)
            ),
        )
        levels.append(q)
    groups = cells.select("lang", "source").distinct()
    fine = groups.alias("g").join(levels[0].alias("a"), F.expr("g.lang <=> a.lang and g.source <=> a.source"), "left").drop(F.col("a.lang"), F.col("a.source"))
    fine = fine.alias("g").join(levels[1].alias("b"), F.expr("g.lang <=> b.lang"), "left").drop(F.col("b.lang"))
    fine = fine.crossJoin(F.broadcast(levels[2]))  # one row

    def pick(col: str) -> Column:
        lang = f"((texts_1 * {col}_1 + {PRIOR} * {col}_0) div (texts_1 + {PRIOR}))"
        return F.expr(f"(texts_2 * {col}_2 + {PRIOR} * {lang}) div (texts_2 + {PRIOR})")

    out = []
    for m, least in MEASURES.items():
        q1, q3 = pick(f"q1_{m}"), pick(f"q3_{m}")
        room = SPREAD * F.greatest(q3 - q1, F.lit(least))
        out.append((q3 + room).alias(f"hi_{m}"))
        out.append((q1 - room if m in TWO_SIDED else F.lit(-1).cast("long")).alias(f"lo_{m}"))
    return fine.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *out)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds _kept: base rules passed and every bucketed measure inside its fences. Groups without a sketch have no text that passes."""
    inside = reduce(lambda x, y: x & y, (bucket(_measure(m)).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")) for m in MEASURES))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.withColumn("_kept", ~F.col("_q.base_failed") & F.coalesce(inside, F.lit(False))).drop(*limits.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's columns for every row of ``docs(doc_id, text, lang, source, ...)``.

    Null lang or source is a group of its own; a null text has no word and fails the base rules; repeated
    rows are judged alike; long texts are read whole; other columns are not read; no rows give no rows.
    """
    measured = pin(base_measures(docs, ["doc_id", "lang", "source"]))
    out = judged(measured, fences(sketch(measured)))
    return out.select("doc_id", *(f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns. Rows are written once beside their measures, for measuring costs far more."""
    names = docs.columns
    whole = docs.select("text", "lang", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    measured = pin(base_measures(whole, ["lang", "source", "_row"]))
    limits = pin(fences(pin(sketch(measured))))
    if limits.count() <= FENCES_SENT:
        limits = F.broadcast(limits)
    return judged(measured, limits).where("_kept").select("_row.*")


def op4_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _oracle() -> str:
    vals = {"word_len": "100*word_chars", "symbols": "1000*n_symbols", "dup_lines": "1000*n_dup_lines", "repeats": "1000*n_repeat_words"}
    value = {m: f"(({v}) // greatest(n_words,1))" for m, v in vals.items()}
    buck = {m: f"(({v} >> greatest(length(bin({v}))-6,0)) << greatest(length(bin({v}))-6,0))" for m, v in value.items()}
    cells = " union all ".join(f"select lang,source,'{m}' as measure,{b} as bucket from base where not base_failed" for m, b in buck.items())
    levels = {2: "lang,source,", 1: "lang,", 0: ""}
    ctes = []
    for level, keys in levels.items():
        ctes.append(f"c{level} as (select {keys}measure,bucket,sum(n) as n from cells group by {keys}measure,bucket)")
        ctes.append(f"r{level} as (select *, sum(n) over (partition by {keys}measure order by bucket) as cum, sum(n) over (partition by {keys}measure) as alln from c{level})")
        qs = ",".join(f"min(case when measure='{m}' and 4*cum >= {k}*alln then bucket end) as q{k}_{m}" for m in MEASURES for k in (1, 3))
        ctes.append(f"q{level} as (select {keys}max(alln) as texts,{qs} from r{level} {'group by ' + keys.rstrip(',') if keys else ''})")
    picked = []
    for m, least in MEASURES.items():
        lang = {k: f"((q1.texts*q1.q{k}_{m} + {PRIOR}*q0.q{k}_{m}) // (q1.texts + {PRIOR}))" for k in (1, 3)}
        q1, q3 = (f"((q2.texts*q2.q{k}_{m} + {PRIOR}*{lang[k]}) // (q2.texts + {PRIOR}))" for k in (1, 3))
        room = f"{SPREAD}*greatest(({q3})-({q1}),{least})"
        picked.append(f"({q3})+{room} as hi_{m}")
        picked.append((f"({q1})-{room}" if m in TWO_SIDED else "-1") + f" as lo_{m}")
    inside = " and ".join(f"{buck[m]} between lo_{m} and hi_{m}" for m in MEASURES)
    ws = r"[\x20\x09-\x0D]"
    return f"""
with t as (select row_number() over () as rid, doc_id, lang, source, coalesce(text,'') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text,'{ws}+'), lambda x: x<>'') as ws from t),
win as (select rid, i, array_to_string(ws[i:i+7],' ') as g from (select rid, ws, unnest(range(1, len(ws)-6)) as i from w where len(ws)>=8)),
rep as (select rid, i from win qualify count(*) over (partition by rid, g) >= 2),
cov as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i+8)) as p from rep) group by rid),
lin as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(text, chr(10))) as l from t) where regexp_replace(l,'{ws}','','g')<>'' group by rid),
m as (select doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(text,'{ws}','','g'))::bigint as word_chars,
 length(regexp_replace(text,'[^{SYMBOLS}]','','g'))::bigint as n_symbols, coalesce(lin.n,0)::bigint as n_dup_lines, coalesce(cov.n,0)::bigint as n_repeat_words
 from w left join cov using(rid) left join lin using(rid)),
base as (select *, (n_words<20 or 100*n_repeat_words>30*n_words) as base_failed from m),
cells as (select lang,source,measure,bucket,count(*) as n from ({cells}) group by all),
{",".join(ctes)},
lim as (select g.lang as f_lang, g.source as f_source, {",".join(picked)} from (select distinct lang,source from cells) g
 left join q2 on g.lang is not distinct from q2.lang and g.source is not distinct from q2.source
 left join q1 on g.lang is not distinct from q1.lang cross join q0)
select doc_id,n_words,word_chars,n_symbols,n_dup_lines,n_repeat_words,base_failed,
 not base_failed and coalesce({inside}, false) as kept
from base left join lim on lang is not distinct from f_lang and source is not distinct from f_source"""


ORACLE = _oracle()
