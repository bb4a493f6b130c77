"""Token counts of documents in flat, unindexed token files by a separator scan.

A file is a stream of little-endian unsigned 16-bit ids; an end-of-document id closes every document and
nothing says where documents start. Files are cut into blocks of fixed size; each block is searched for
separators in one vectorised pass; a prefix scan over the blocks' summaries (separators, ids after the last
one) numbers the documents and stitches those that reach over block boundaries.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import pin, shared_dir, text_or_empty

#: End of document in the public vocabulary. Its string in a text is ordinary text, so no document holds the id.
SEPARATOR = 49407
BLOCK_BYTES = 4 << 20
NAME = "tokens-%06d.bin"


def _open_folder(uri: str):
    """A file system that workers and driver reach alike, and the folder's path in it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Writes the ids of ``docs(doc_id, text)`` as flat files, one per partition; (file, bytes, ordinal, doc_id) of every document.

    A file appears under its name when it is whole; a repeated task replaces it by an equal one.
    """
    import pyarrow as pa

    def write(batches):
        from pyspark import TaskContext

        from lodestack.llm.tokens import encoder, slices

        store, base = _open_folder(folder)
        enc, end = encoder(vocabulary, literal=True), separator.to_bytes(2, "little")
        file = TaskContext.get().partitionId()
        name = f"{base}/{NAME % file}"
        part = f"{base}/_{uuid.uuid4().hex}"
        store.create_dir(base, recursive=True)
        ordinal = size = 0
        rows = []
        with store.open_output_stream(part) as out:
            for batch in batches:
                for start, texts in slices(batch.column(1)):
                    data = b"".join([ids + end for ids in enc.encode(texts)])
                    out.write(data)
                    size += len(data)
                    rows.append((batch.column(0).slice(start, len(texts)), ordinal))
                    ordinal += len(texts)
        store.move(part, name)
        for ids, first in rows:
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int32()), pa.array([size] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), ids], names=["file", "bytes", "ordinal", "doc_id"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return pin(given.mapInArrow(write, "file int, bytes long, ordinal long, doc_id long"))


def scan_token_files(files: DataFrame, folder: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``files(path, bytes)`` -> (path, ordinal, n_tokens, complete) per document.

    Ids after the last separator of a file are a document that is not complete; an empty file has none. A
    document may span any number of blocks.
    """
    import pyarrow as pa

    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    blocks = blocks.repartition("path", "block")
    names = ["path", "block", "seps", "tail", "lengths"]

    def search(batches):
        store, _ = _open_folder(folder)
        for batch in batches:
            for path, total, block in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "block")), strict=True):
                at = block * block_bytes
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, total - at), at), dtype="<u2")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(np.concatenate([[-1], ends])) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                cols = ([path], [block], [len(ends)], [tail], [lengths.tolist()])
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    found = pin(blocks.mapInArrow(search, "path string, block long, seps long, tail long, lengths array<long>"))
    w = Window.partitionBy("path").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # A run of blocks starts after each block with a separator; what is left over adds up along a run.
    summary = found.select("path", "block", "seps", "tail").withColumn("first", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    summary = summary.withColumn("run", F.coalesce(F.sum((F.col("seps") > 0).cast("int")).over(w), F.lit(0)))
    along = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("left", F.sum("tail").over(along))
    summary = summary.withColumn("carry", F.coalesce(F.lag("left").over(w), F.lit(0))).withColumn("last", F.lead("block").over(w).isNull())
    scanned = found.select("path", "block", "lengths").join(summary, ["path", "block"])
    each = scanned.select("path", "first", "carry", F.posexplode("lengths").alias("i", "n"))
    whole = each.select("path", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(F.lit(0))).alias("n_tokens"), F.lit(True).alias("complete"))
    rest = summary.where(F.col("last") & (F.col("left") > 0)).select("path", (F.col("first") + F.col("seps")).alias("ordinal"), F.col("left").alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file, ordinal per row of ``docs(doc_id, text)``, by way of flat token files.

    A null or blank text has no token; repeated rows are counted each; long texts are whole; other columns
    are not read; no rows, no result. The separator is not counted.
    """
    folder = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    places = write_token_files(docs, folder, vocabulary)
    path = F.concat(F.lit(f"{_open_folder(folder)[1]}/"), F.format_string(NAME, "file"))
    files = places.groupBy("file").agg(F.max("bytes").alias("bytes")).select(path.alias("path"), "bytes")
    counts = scan_token_files(files, folder).withColumn("file", F.regexp_extract("path", r"tokens-(\d+)\.bin$", 1).cast("int"))
    return places.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
