"""Media columns: texts stored as lossless WebP and read back.

A text's bytes, padded with zeros to a positive multiple of 64, become the four 8-bit samples of ARGB
pixels, in tiles of 8 KiB. Every file is decoded again, and checksums and features come from what was read back.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import webp
from lodestack.llm.common import text_or_empty

UNIT = 64
#: Pixels in a row; bytes of an image. Tiles bound the rows of an image and let long texts be decoded in many lanes.
WIDTH, TILE = 16, 8192


def payload(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b"\0" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def store(data: bytes) -> bytes:
    """A payload as WebP files one after another, TILE bytes in each but the last; each file tells its length."""
    return b"".join([webp.encode(np.frombuffer(data[i : i + TILE], dtype="<u4"), WIDTH) for i in range(0, len(data), TILE)])


def tiles(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(stored[at:end])
        at = end
    return out


def load(stored: list[bytes]) -> list[bytes]:
    """Payloads; all tiles are decoded together."""
    parts = [tiles(f) for f in stored]
    decoded = iter(webp.decode_many([t for p in parts for t in p]))
    return [b"".join([np.ascontiguousarray(next(decoded)[0], dtype="<u4").tobytes() for _ in p]) for p in parts]


def feature(data: bytes) -> str:
    """Shares of the sixteen ranges of sample values, and the mean of each channel, as hex digits."""
    samples = np.frombuffer(data, dtype=np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    means = samples.reshape(-1, 4).sum(axis=0, dtype=np.int64) // (len(samples) // 4)
    return bytes([*shares.tolist(), *means.tolist()]).hex()


def media_column(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """The contract's columns (and ``media``, the file) per row of ``docs(doc_id, text)``.

    A null text is empty and stored as 64 zeros; equal texts give equal values; long texts are stored whole;
    other columns are not read; no rows, no result.
    """
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if keep_media else [])]

    def run(batches):
        from lodestack.llm.tokens import slices

        for batch in batches:
            for start, texts in slices(batch.column(1), 4096, 8 << 20):
                data = [payload(t) for t in texts]
                sizes = [len(d) for d in data]
                files = [store(d) for d in data]
                back = load(files)
                cols = [
                    batch.column(0).slice(start, len(texts)), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([zlib.crc32(b[-UNIT:]) for b in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([feature(b) for b in back]),
                ]
                if keep_media:
                    cols.append(pa.array(files, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
