"""Language-model scores by a weighted backoff automaton.

All 1- to 3-grams of the training texts are counted, none is left out. An n-gram is known by a 63-bit hash of its
words. A history h of count c(h) gives p(w|h) = (c(hw) + PRIOR p(w|h')) / (c(h) + PRIOR), h' being h without its
first word; single words have (c + 1) / (N + V + 1), where all words not trained on are one. As an automaton: a
state is a history, an arc carries the log-probability of an n-gram and leads to the longest history that is a state, a
failure arc carries log PRIOR / (c(h) + PRIOR) and leads to the next shorter history. A text is read once from left
to right: the state is carried, log-probabilities are summed.

The counts grow with the corpus, so nobody holds them all. Texts are cut into blocks of at most BLOCK tokens (a longer
text is a block of its own). Every block asks for the n-grams that it holds and says how often it trains on each;
shards of the range of hashes add up what all blocks say and answer with the whole counts; the block then
builds the part of the automaton that its texts can reach. Only sums come to the driver, nothing is broadcast.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import lower_ascii, pin, shared_dir, short_lived_shuffles, text_or_empty

#: Weight of the shorter history's distribution, in tokens.
PRIOR = 4.0
#: Tokens of a block, and n-grams that a shard holds on average.
BLOCK, SHARD = 1_250_000, 1_500_000
END = 0
#: Key of the end token in tables; no word holds a space.
END_KEY = b" "
#: Tokens that a lane reads; a longer text is read in several lanes, each started two tokens early.
LANE = 512
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def split_words(raw: bytes | None) -> list[bytes]:
    return lower_ascii(raw or b"").split()


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, each compressed on its own: those of hashes are noise in the low planes and nothing in the high ones."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    parts = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in planes]
    return np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(parts)


def _unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    ends = 4 * width + np.concatenate([[0], np.cumsum(np.frombuffer(data, dtype="<u4", count=width), dtype=np.int64)])
    planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(data[a:b]), dtype=np.uint8) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.stack(planes, axis=1).view(kind).ravel()


BLOCK_SCHEMA = "block string, doc_ids array<long>, held array<boolean>, sizes array<long>, symbols binary, words binary, tokens long"


def write_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(doc_id long, text binary, held_out)``, written to the shared folder: texts as numbers of the block's own words."""
    import pyarrow as pa

    def cut(batches):
        import xxhash

        def out():
            words = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in index), dtype=np.uint64, count=len(index))
            row = [uuid.uuid4().hex], [ids], [held], [sizes], [_packed(np.array(flat, dtype=np.int32))], [words.tobytes()], [len(flat)]
            kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()
            names = ["block", "doc_ids", "held", "sizes", "symbols", "words", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        index, flat, ids, held, sizes = {END_KEY: END}, [], [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                words = split_words(batch.column(1)[i].as_py())
                if flat and len(flat) + len(words) >= BLOCK:
                    yield out()
                    index, flat, ids, held, sizes = {END_KEY: END}, [], [], [], []
                flat += [index.setdefault(w, len(index)) for w in words]
                flat.append(END)
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(2)[i].as_py())
                sizes.append(len(words) + 1)
        if flat:
            yield out()

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lm-blocks-{uuid.uuid4().hex}"
    docs.mapInArrow(cut, BLOCK_SCHEMA).write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor, shift in zip(_ODD, (29, 32), strict=True):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def ngram_keys(symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams that end at each token, one order after another, and which tokens have a 3-gram.

    What comes before the end of a text is no history. Hashes of single words are odd, all others even.
    """
    w = words[symbols]
    before = np.concatenate([words[END : END + 1], w[:-1]])
    third = np.concatenate([[END], symbols[:-1]]) != END
    third[:1] = False
    two = _mixed(before * _ODD[1] + _mixed(w))
    past = np.concatenate([np.zeros(1, dtype=np.uint64), two[:-1]])
    three = _mixed(past[third] * _ODD[0] + w[third])
    even = ~np.uint64(1)
    return np.concatenate([_mixed(w) | np.uint64(1), two & even, three & even]), third


def _distinct(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a block, its hashes in order, the place of each n-gram among them, which tokens have a 3-gram."""
    symbols = _unpacked(row["symbols"], np.int32)
    keys, third = ngram_keys(symbols, np.frombuffer(row["words"], dtype=np.uint64))
    keys, places = np.unique(keys, return_inverse=True)
    return symbols, keys, places.astype(np.int32), third


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def whole_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, counts, n, v): the training counts of a block's n-grams in the order of their hashes; n and v add up to N and V."""
    import pyarrow as pa

    edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)

    def ask(batches):
        for row in _rows(batches):
            _, keys, places, third = _distinct(row)
            trained = np.repeat(~np.array(row["held"], dtype=bool), row["sizes"])
            said = np.bincount(places, weights=np.concatenate([trained, trained, trained[third]]), minlength=len(keys)).astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                steps = np.diff(keys[part], prepend=np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int64()), pa.array([row["block"]]), pa.array([_packed(steps)], pa.binary()), pa.array([_packed(said[part])], pa.binary())],
                    names=["shard", "block", "keys", "said"],
                )

    def answer(table):
        keys = [np.cumsum(_unpacked(k.as_py(), np.uint64), dtype=np.uint64) for k in table.column("keys")]
        said = np.concatenate([_unpacked(c.as_py(), np.uint32) for c in table.column("said")])
        distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(places, weights=said, minlength=len(distinct)).astype(np.int64)
        single = sums[(distinct & np.uint64(1)) == 1]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        counts = [_packed(sums[p]) for p in np.split(places, cuts)]
        rest = [0] * (len(keys) - 1)
        return pa.table(
            [table.column("block"), table.column("shard"), pa.array(counts, pa.binary()), pa.array([int(single.sum()), *rest], pa.int64()), pa.array([int((single > 0).sum()), *rest], pa.int64())],
            names=["block", "shard", "counts", "n", "v"],
        )

    with short_lived_shuffles(blocks.sparkSession):
        asked = blocks.mapInArrow(ask, "shard long, block string, keys binary, said binary")
        return pin(asked.groupBy("shard").applyInArrow(answer, "block string, shard long, counts binary, n long, v long"))


class Automaton:
    """States 0 (no history), then one- and two-symbol histories; arcs sorted by (state, symbol).

    Log-probabilities are to base ten. State 0 has an arc for every symbol. ``ones``: count by symbol. ``twos``:
    first symbol, second symbol and count of every distinct 2-gram that has a count; ``threes``: the numbers in ``twos``
    of the first and the last two symbols, the last symbol and the count of every such 3-gram.
    """

    def __init__(self, ones: np.ndarray, twos: tuple, threes: tuple, n: int, v: int):
        k = self.k = len(ones)
        (a, b, two_counts), (old, new, last, three_counts) = twos, threes
        p1 = (ones + 1.0) / (n + v + 1.0)
        self.after = np.where(ones > 0, np.cumsum(ones > 0), 0).astype(np.int64)
        first = 1 + int((ones > 0).sum())
        history = np.concatenate([[0], ones[ones > 0], two_counts])
        self.fail = np.concatenate([np.zeros(first, dtype=np.int64), self.after[b]])
        self.backoff = np.log10(PRIOR / (history + PRIOR))
        self.unigram = np.log10(p1)
        p2 = (two_counts + PRIOR * p1[b]) / (ones[a] + PRIOR)
        p3 = (three_counts + PRIOR * p2[new]) / (two_counts[old] + PRIOR)
        keys = np.concatenate([self.after[a] * k + b, (first + old.astype(np.int64)) * k + last])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.logp = np.log10(np.concatenate([p2, p3]))[order]
        self.start = int(self.after[END])
        # After an end comes a new text.
        self.next = np.where(self.keys % k == END, self.start, np.concatenate([first + np.arange(len(a)), first + new])[order])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities and next states; failure arcs are followed until an arc fits."""
        gain, out = np.zeros(len(states)), np.empty(len(states), dtype=np.int64)
        todo = np.arange(len(states))
        at = states
        while len(todo):
            label = symbols[todo]
            want = at * self.k + label
            where = np.searchsorted(self.keys, want)
            hit = np.zeros(len(todo), dtype=bool)
            inside = where < len(self.keys)
            hit[inside] = self.keys[where[inside]] == want[inside]
            base = (at == 0) & ~hit
            gain[todo[hit]] += self.logp[where[hit]]
            out[todo[hit]] = self.next[where[hit]]
            gain[todo[base]] += self.unigram[label[base]]
            out[todo[base]] = self.after[label[base]]
            rest = ~(hit | base)
            todo, at = todo[rest], at[rest]
            gain[todo] += self.backoff[at]
            at = self.fail[at]
        return gain, out

    def score(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums per text. ``symbols``: all texts one after another, each with its end, ``ends``: places after the ends."""
        starts = np.concatenate([[0], ends[:-1]])
        owner, begin, stop, warm = [], [], [], []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            for x in range(a, b, LANE):
                owner.append(i)
                begin.append(max(a, x - 2))
                warm.append(min(2, x - a))
                stop.append(min(b, x + LANE))
        order = np.argsort(np.array(begin) - np.array(stop), kind="stable")
        owner, begin, stop, warm = (np.array(v)[order] for v in (owner, begin, stop, warm))
        length = stop - begin
        states = np.where(begin == starts[owner], self.start, 0)
        sums = np.zeros(len(owner))
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, side="left"))
            gain, states[:active] = self.step(states[:active], symbols[begin[:active] + t])
            sums[:active] += np.where(t >= warm[:active], gain, 0.0)
        return np.bincount(owner, weights=sums, minlength=len(ends))


def _counted(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place in ``ids`` of every id that has a count; by id the number of that place, -1 for others."""
    at = np.full(len(counts), -1, dtype=np.int32)
    at[ids] = np.arange(len(ids))
    found = np.flatnonzero((at >= 0) & (counts > 0))
    number = np.full(len(counts), -1, dtype=np.int32)
    number[found] = np.arange(len(found))
    return at[found], number


def _automaton(symbols: np.ndarray, counts: np.ndarray, places: np.ndarray, third: np.ndarray, n: int, v: int) -> tuple[Automaton, np.ndarray]:
    """The automaton of a block and the count of each of its tokens."""
    one, two, three = np.split(places, [len(symbols), 2 * len(symbols)])
    ones = np.zeros(int(symbols.max()) + 1, dtype=np.int64)
    ones[symbols] = counts[one]
    at, number = _counted(two, counts)
    twos = np.where(at > 0, symbols[at - 1], END), symbols[at], counts[two[at]]
    of, _ = _counted(three, counts)
    at = np.flatnonzero(third)[of]
    threes = number[two[at - 1]], number[two[at]], symbols[at], counts[three[of]]
    return Automaton(ones, twos, threes, n, v), counts[one]


def lm_scores(docs: DataFrame) -> DataFrame:
    """The contract's columns per row of ``docs(doc_id, text)``.

    A null or wordless text is its end alone. A null doc_id has the fold of the empty text. Without training
    rows every count is zero. Repeated rows score alike; other columns are not read; no rows, no result.
    """
    import pyarrow as pa

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    blocks = write_blocks(given)
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    answers = whole_counts(blocks, max(1, -(-3 * tokens // (2 * SHARD))))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def score(batches):
        for row in _rows(batches):
            counts = np.concatenate([_unpacked(a["counts"], np.int64) for a in row["answers"]])
            symbols, _, *where = _distinct(row)
            automaton, one = _automaton(symbols, counts, *where, n, v)
            del counts, where
            sizes = np.array(row["sizes"])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(owner, weights=np.log10(one + 1.0), minlength=len(sizes)) - sizes * math.log10(n + v + 1)
            known = np.bincount(owner, weights=one > 0, minlength=len(sizes)).astype(np.int64)
            lm = automaton.score(symbols.astype(np.int64), np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(lm)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    each = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "counts"))).alias("answers"))
    return blocks.join(each, "block").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
