"""Language identification by compression.

A language's model is a Zstandard raw-content dictionary: whole training texts of that language, one after
another. A text is cut into blocks; every block is compressed with every dictionary, and the language whose
blocks come out smallest in sum is chosen. The margin to the next language tells how sure that is; narrow
margins are rejected.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import text_or_empty

#: Bounds of the training sample: texts per language, bytes of one text.
SAMPLE_TEXTS, TEXT_BYTES = 400, 1024
BLOCK_BYTES = 4096
#: Short matches count in short texts: lazy parsing with matches of four bytes or more. Tables hold every
#: place of a full dictionary; smaller ones would forget its first texts.
MIN_MATCH, WINDOW_LOG, TABLE_LOG, SEARCH_LOG = 4, 19, 19, 4
#: Rejected below this relative margin between the smallest and the next size.
LEAST_MARGIN = 0.002
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text; null is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language, from a bounded sample of labelled rows spread by a hash of their text.

    The texts with the least hashes are taken, SAMPLE_TEXTS of each language or all there are; equal texts count
    once, however many rows they have. Hashes alone are ranked, first within each partition. What the driver gets is bounded
    per language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    given = labelled.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, TEXT_BYTES).alias("text"))
    w = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.col("h"), 11), "h")
    least = given.select("lang", "h").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_TEXTS)
    # Samples only: a text that is judged is read whole.
    rows = given.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    content: dict[str, bytes] = {}
    for lang in sorted({r.lang for r in rows}):
        mine = sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)
        content[lang] = b"\n".join(r.text.lower().encode("utf-8", "replace")[:TEXT_BYTES] for r in mine)
    return content


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters(
            window_log=WINDOW_LOG, chain_log=TABLE_LOG, hash_log=TABLE_LOG, search_log=SEARCH_LOG, min_match=MIN_MATCH,
            strategy=zstd.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.langs = sorted(content)
        self.compressors = []
        for lang in self.langs:
            d = zstd.ZstdCompressionDict(content[lang] or b"\n" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin in 0..1); ``und`` and 0 if there is nothing to judge by. Ties go to the first name."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], (min(rest) - sizes[best]) / max(min(rest), 1) if rest else 1.0


def with_language(docs: DataFrame, content: dict[str, bytes], out: str = "_lang") -> DataFrame:
    """Adds ``out``: struct(lang_pred, score, accepted). A null text, or one without a letter, is ``und`` and not accepted."""

    schema = "lang_pred string, score double, accepted boolean"

    @F.pandas_udf(schema)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(content)
        for texts in batches:
            found = [classify(t) for t in texts]
            langs, margins = [f[0] for f in found], [f[1] for f in found]
            accepted = [f[0] != UNKNOWN and f[1] >= LEAST_MARGIN for f in found]
            yield pd.DataFrame({"lang_pred": langs, "score": margins, "accepted": accepted})

    return docs.withColumn(out, judge(text_or_empty()))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted per row of ``docs(doc_id, text, lang)``.

    Rows whose fold is 2 are held out; no label at all makes every text ``und``. lang, source and doc_id are
    not read to predict. Repeated rows are judged alike; long texts whole; an empty table gives no rows.
    """
    held = F.pmod(fold(F.col("doc_id")), F.lit(4)) == 2
    content = train(docs.where(~held).select("lang", "text"))
    judged = with_language(docs.select("doc_id", "text", held.alias("held_out")), content)
    return judged.select("doc_id", "held_out", "_lang.lang_pred", "_lang.score", "_lang.accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns; models learn from the labelled rows of ``docs``."""
    names = docs.columns
    whole = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    return with_language(whole, train(docs.select("lang", "text"))).where("_lang.accepted").select("_row.*")


def op3_query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
