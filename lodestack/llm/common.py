"""What the operators of this subpackage share: materialisation, running totals, row keys."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of anything but the six ASCII white-space characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(data: bytes) -> bytes:
    """Lower-case A-Z only, as the contracts of the operators ask."""
    return data.translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where executors are threads of the driver (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return sc.getCheckpointDir().rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    directory = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(directory)
    return df.checkpoint()


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Tables made and run inside leave no shuffle files behind; pin them here, and use none but the pinned ones after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building them: starts of runs of non-space characters."""
    blanked = F.trim(F.translate(text, WS_CHARS, " " * len(WS_CHARS)))
    squeezed = F.regexp_replace(blanked, " +", " ")
    return F.when(blanked == "", F.lit(0).cast("long")).otherwise(
        (F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")
    )


def running_totals(df: DataFrame, group: list[str], order: list[str], values: str | list[str], outs: str | list[str]) -> DataFrame:
    """Add ``outs``: the sums of ``values`` over the rows of the same group that come earlier.

    A distributed prefix scan. Rows are range-partitioned by (group, order), so a hot group spreads over
    many partitions; each partition sums on its own; the totals of (partition, group), at most partitions
    plus groups rows, are scanned and added back. ``group`` columns must not be null; rows that tie on
    ``order`` must be interchangeable. Order and group columns stay in the result.
    """
    values, outs = ([values], [outs]) if isinstance(values, str) else (values, outs)
    local = [f"_rt_local{i}" for i in range(len(values))]
    keys = [*group, *order]
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_rt_pid", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in local)])

    def scan(batches):
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, [0] * len(values)
        for pdf in batches:
            if not len(pdf):
                continue
            new = pd.Series(False, index=pdf.index)
            for g in group:
                new |= pdf[g].ne(pdf[g].shift())
            if group:
                new.iloc[0] = tuple(pdf[g].iloc[0] for g in group) != last
                last = tuple(pdf[g].iloc[-1] for g in group)
            for i, value in enumerate(values):
                v = pdf[value].astype("int64")
                before = v.cumsum() - v
                base = before.where(new).ffill()
                held = (before - base.fillna(0).astype("int64") + base.isna().astype("int64") * carry[i]).astype("int64")
                carry[i] = int(held.iloc[-1] + v.iloc[-1])
                pdf[local[i]] = held
            pdf["_rt_pid"] = pid
            yield pdf[[f.name for f in schema.fields]]

    scanned = pin(ranged.mapInPandas(scan, schema))
    totals = scanned.groupBy("_rt_pid", *group).agg(*(F.sum(v).alias(f"_rt_sum{i}") for i, v in enumerate(values)))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_rt_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_rt_pid", *group, *(F.coalesce(F.sum(f"_rt_sum{i}").over(w), F.lit(0)).alias(f"_rt_before{i}") for i in range(len(values))))
    added = scanned.join(before, ["_rt_pid", *group])
    return added.select(*df.columns, *((F.col(f"_rt_before{i}") + F.col(c)).alias(o) for i, (c, o) in enumerate(zip(local, outs, strict=True))))
