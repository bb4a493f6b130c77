"""Mixture-controlled packing by deficit round robin over source queues.

Every window takes from every queue its quantum, the window's length times the queue's target proportion; what
rounding leaves over or short is carried to the next window, whichever partition its documents lie in. The
targets are the queues' shares of all tokens, the only ones that every window can keep until the last; a mix of
other weights is made before (see mixing.py).

The carried deficits have a closed form. Let R(j) be the share of the first j queues. Before window k they have
been served floor(k * 4096 * R(j)) tokens, so a queue has been served the difference of two neighbours, its own
quantum times k give or take one, and the queues together exactly 4096 * k. A document's windows and offsets
follow from its place in its queue alone, and documents are cut where a window's share ends. Places are running
totals: within a partition they are counted while encoding, across partitions one prefix scan over the
partitions' totals adds what lies before, and no token moves.

A source with less than LEAST_QUANTUM tokens a window has no queue of its own; these sources share one, in
storage order. So there are at most 4096 / LEAST_QUANTUM queues, however many sources there are.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import pin, running_totals, shared_dir, text_or_empty

WINDOW = 4096
END_ID = 2
#: Tokens a window: with over two, no rounding makes a share negative.
LEAST_QUANTUM = 2.01
#: Totals of so many (partition, source), some 40 bytes each, are sent to all tasks; more are joined by a shuffle.
TOTALS_SENT = 100_000


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, source, n, before, ids) of ``docs(doc_id, text, source)``, kept as a table in the shared folder.

    ids are unsigned 16-bit; ``end_id`` closes every document. before: tokens of the same source that lie
    earlier in the same part, a number of the partition that encoded them.
    """
    import pyarrow as pa

    names = ["part", "doc_id", "source", "n", "before", "ids"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def encode(batches):
        from pyspark import TaskContext

        from lodestack.llm.tokens import encoder, slices

        enc, end = encoder(vocabulary), end_id.to_bytes(2, "little")
        part, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                ids = [i + end for i in enc.encode(texts)]
                rows = batch.slice(start, len(texts))
                sizes, before = [len(i) // 2 for i in ids], []
                for source, n in zip(rows.column(1).to_pylist(), sizes, strict=True):
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + n
                numbers = (pa.array(v, pa.int64()) for v in ([part] * len(ids), sizes, before))
                p, n, b = numbers
                yield pa.RecordBatch.from_arrays([p, rows.column(0), rows.column(1), n, b, pa.array(ids, pa.binary())], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().cast("binary").alias("text"))
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    given.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Rounds:
    """The schedule: ``ends``, tokens of the first 1, 2, ... queues, is all that it depends on."""

    ends: np.ndarray

    def __post_init__(self):
        self.total = int(self.ends[-1]) if len(self.ends) else 0
        self.windows = -(-self.total // WINDOW)
        self.cum = np.concatenate([[0], self.ends]).astype(np.int64)
        self.share = self.cum / max(self.total, 1)

    def prefix(self, window: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Tokens that the first ``queues`` queues have been served before the window."""
        tokens = np.floor(window * WINDOW * self.share[queues]).astype(np.int64)
        return np.where(window >= self.windows, self.cum[queues], tokens)

    def served(self, window: np.ndarray, queue: np.ndarray) -> np.ndarray:
        return self.prefix(window, queue + 1) - self.prefix(window, queue)

    def window_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window that serves the queue's token at ``place``."""
        quantum = np.maximum(self.share[queue + 1] - self.share[queue], 1e-300) * WINDOW
        k = np.clip(np.floor(place / quantum).astype(np.int64), 0, max(self.windows - 1, 0))
        while True:
            step = (self.served(k + 1, queue) <= place).astype(np.int64) - (self.served(k, queue) > place)
            if not step.any():
                return k
            k = k + step

    def pieces(self, queue: np.ndarray, place: np.ndarray, n: np.ndarray):
        """(document, start, length, window, offset) of documents of ``n`` tokens that begin at ``place`` of their queues."""
        first, last = self.window_of(queue, place), self.window_of(queue, place + n - 1)
        count = last - first + 1
        doc = np.repeat(np.arange(len(n)), count)
        window = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        q, at = queue[doc], place[doc]
        begin = self.served(window, q)
        start, stop = np.maximum(at, begin), np.minimum(at + n[doc], self.served(window + 1, q))
        offset = self.prefix(window + 1, q) - self.prefix(window, q) + start - begin
        some = stop > start
        return tuple(v[some] for v in (doc, start - at, stop - start, window, offset))

    def padded(self, window: np.ndarray) -> np.ndarray:
        """4096, or what is filled where that is a power of two."""
        full = np.minimum(WINDOW, self.total - window * WINDOW)
        return np.where(full & (full - 1) == 0, full, WINDOW)


def queues_of(totals: DataFrame) -> tuple[dict[str | None, int], Rounds]:
    """Queue of every source that has one of its own, and the schedule; ``totals(source, total)``. At most 4096 / LEAST_QUANTUM sources are collected."""
    every = totals.agg(F.sum("total")).first()[0] or 0
    own = totals.where(F.col("total") * WINDOW >= LEAST_QUANTUM * every).collect()
    own = sorted(own, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.total) for r in own]
    shared = every - sum(sizes)
    if shared and shared * WINDOW < LEAST_QUANTUM * every and own:
        least = min(range(len(own)), key=sizes.__getitem__)
        own, sizes = own[:least] + own[least + 1 :], sizes[:least] + sizes[least + 1 :]
        shared = every - sum(sizes)
    return {r.source: i for i, r in enumerate(own)}, Rounds(np.cumsum([*sizes, *([shared] if shared else [])]))


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A null text is a document of its end alone; a null source is a queue; repeated rows are packed as often
    as they come; documents are cut where a window's share of their queue ends; other columns are not read; no
    rows, no pieces. padded_length is 4096, or the filled length where that is a power of two.
    """
    tokens = tokenized(docs, vocabulary)
    sums = pin(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    own, rounds = queues_of(sums.groupBy("source").agg(F.sum("n").alias("total")))
    rest = len(own)
    if own:
        named = F.create_map(*(F.lit(x) for s, q in own.items() if s is not None for x in (s, q))) if any(s is not None for s in own) else None
        queue = F.when(F.col("source").isNull(), F.lit(own.get(None, rest))).otherwise(F.coalesce(named[F.col("source")], F.lit(rest)) if named is not None else F.lit(rest))
    else:
        queue = F.lit(rest)
    starts = running_totals(sums.withColumn("queue", queue.cast("int")), ["queue"], ["part", "source"], "n", "earlier")
    starts = pin(starts.select(F.col("part").alias("s_part"), F.col("source").alias("s_source"), "queue", "earlier"))
    if starts.count() <= TOTALS_SENT:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, (F.col("part") == F.col("s_part")) & F.col("source").eqNullSafe(F.col("s_source")))
    placed = placed.select("doc_id", "ids", "n", "queue", (F.col("earlier") + F.col("before")).alias("place"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            n, queue, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4))
            if not len(n):
                continue
            doc, start, length, window, offset = rounds.pieces(queue, place, n)
            crc, last, wide = [], -1, memoryview(b"")
            for d, a, size in zip(doc.tolist(), (4 * start).tolist(), (4 * length).tolist(), strict=True):
                if d != last:
                    last, wide = d, memoryview(np.frombuffer(batch.column(1)[d].as_py(), dtype="<u2").astype("<u4").tobytes())
                crc.append(zlib.crc32(wide[a : a + size]))
            out = [start, length, np.array(crc, dtype=np.int64), n[doc], window, offset, rounds.padded(window)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(v, pa.int64()) for v in out)], names=names)

    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in names))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
