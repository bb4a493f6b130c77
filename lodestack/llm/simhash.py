"""SimHash near-duplicates by multi-index hashing.

Every text becomes a fingerprint of 64 or more bits. Fingerprints are cut into 32-bit segments; a table
holds every distinct fingerprint under each of its segments. A probe enumerates the small Hamming ball
around each of its segments, fetches the table's matches, and complete distances are verified in the join
itself. With two segments and a limit of three bits, one segment differs in at most one bit, so balls of
radius one find every link.

No step makes all pairs of a group. Equal fingerprints collapse to one class first. The first round links
every probe to one centre of each bucket it meets; the second joins buckets of two or more in full, but
keeps links between different components only, so what it makes stays near the number of classes.

The pipeline's near copies are told by five-word shingles instead. At a similarity of 0.8 some 15 of 100 bits of
a SimHash differ, so their fingerprints have 2304 bits, cut into 96 segments of 24: a ball of radius one around
a segment meets one such pair in ten, and all segments together miss one in some 30,000. Balls are met within
shards of the table; the distance of the first 128 bits is checked there, the complete similarity afterwards.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import lower_ascii, pin, short_lived_shuffles, text_or_empty
from lodestack.llm.components import connected_components

SEGMENT_BITS = 32
#: Near copies of the pipeline: words of a shingle, least Jaccard similarity of the shingle sets.
SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: Segments of a near-copy fingerprint, their bits; bits of the first 128 that may differ (near copies: 19.4 of 128 at
#: the least similarity, with a deviation of 4.1; other texts 64).
NEAR_SEGMENTS, NEAR_BITS, NEAR_MOST = 96, 24, 42
#: Classes up to which a segment is one shard; with more, either half of it is kept whole and the shards are so large.
SHARD_ROWS = 1_000_000
#: Rows in the ball around a segment, beyond four times those that chance puts there, from which on they meet by prefixes, not by pairs.
CROWD = 8
#: Members of a key that are joined in full from the second turn on; turns, the last of which joins all the rest.
SMALL, TURNS = 16, 4
_SALTS = np.random.default_rng(20).integers(1 << 63, size=NEAR_SEGMENTS * NEAR_BITS // 64, dtype=np.uint64)
_ROW = np.dtype([("value", "<u4"), ("node", "<i8"), ("head", "<u8", 2)])
#: Odd factor that mixes the hashes of a shingle's words.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _features(words: list[bytes], width: int, distinct: bool) -> list[bytes]:
    if not words:
        return []
    if width == 1:
        found = words
    elif len(words) < width:
        found = [b" ".join(words)]
    else:
        found = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return list(set(found)) if distinct else found


def fingerprint(text: str | None, width: int = 3, longs: int = 1, distinct: bool = False) -> list[int]:
    """Fingerprint as signed 64-bit integers; no word (or null) gives zeros.

    A bit is set if it is set in over half of the features' XXH64 values. Seeds are 42, 43, ... for the
    successive 64-bit parts.
    """
    import xxhash

    # str.split() would also split at non-ASCII spaces; bytes.split() knows the six ASCII ones only.
    feats = _features(lower_ascii((text or "").encode("utf-8", "surrogatepass")).split(), width, distinct)
    if not feats:
        return [0] * longs
    out = []
    for part in range(longs):
        digest = xxhash.xxh64_digest
        raw = np.frombuffer(b"".join([digest(f, 42 + part) for f in feats]), dtype=np.uint8).reshape(-1, 8)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(raw), 65536):
            ones += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(feats)).tobytes(), "big", signed=True))
    return out


def with_fingerprints(df: DataFrame, width: int, longs: int, distinct: bool, out: str = "_fp") -> DataFrame:
    @F.pandas_udf("array<long>")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, longs, distinct) for t in texts])

    return df.withColumn(out, fp(text_or_empty()))


def ball_masks(radius: int, bits: int = SEGMENT_BITS) -> list[int]:
    """XOR masks of the Hamming ball; a pair at distance d > 0 is met from exactly one of its ends (see _probes)."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


def _table(classes: DataFrame, segments: int) -> DataFrame:
    """One row per (class, segment): key = segment number and its 32 bits; head = the first 64 bits of the fingerprint."""
    parts = []
    for s in range(segments):
        word = F.col("_fp")[s // 2]
        half = F.shiftrightunsigned(word, 32) if s % 2 == 0 else word.bitwiseAND(F.lit(0xFFFFFFFF))
        parts.append(half.bitwiseOR(F.lit(s << 32)))
    return classes.select("node", F.col("_fp")[0].alias("head"), *(c for c in classes.columns if c == "label"), F.explode(F.array(*parts)).alias("key"))


def _probes(table: DataFrame, radius: int) -> DataFrame:
    """The ball of every key. Of two keys that differ, the one with the lowest differing bit set does the probing."""
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks(radius)))
    mine = F.filter(masks, lambda m: (m == 0) | (F.col("key").bitwiseAND(m.bitwiseAND(-m)) != 0))
    return table.withColumn("key", F.explode(F.transform(mine, lambda m: F.col("key").bitwiseXOR(m))))


def _ends(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def hamming_components(classes: DataFrame, segments: int, radius: int, most: int) -> DataFrame:
    """``classes(node long, _fp array<long>)``, fingerprints distinct -> ``(node, comp)`` of the linked classes.

    ``most``: differing bits allowed.
    """
    near = lambda x: F.bit_count(F.col(x).bitwiseXOR(F.col("head"))) <= most
    table = _table(classes, segments)
    centres = table.groupBy("key").agg(F.min(F.struct("node", "head")).alias("c"), F.count("*").alias("n"))
    centres = centres.select(F.col("key").alias("k"), F.col("c.node").alias("centre"), F.col("c.head").alias("chead"), "n")
    first = _probes(table, radius).join(centres.drop("n"), (F.col("k") == F.col("key")) & (F.col("centre") != F.col("node")) & near("chead"))
    links = pin(first.select(*_ends("node", "centre")).distinct())
    # Two steps to the least neighbour. Classes with one label are linked, so the second round may leave out their pairs.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("l1"))
    two = one.join(one.select(F.col("node").alias("l1"), F.col("l1").alias("l2")), "l1", "left").select("node", F.coalesce("l2", "l1").alias("l"))
    labelled = classes.join(two, "node", "left").select("node", "_fp", F.coalesce("l", "node").alias("label"))
    crowded = centres.where("n > 1").select(F.col("k").alias("key"), "centre")
    rest = pin(
        _table(labelled, segments).join(crowded, "key").where("node <> centre")
        .select(F.col("key").alias("k"), F.col("node").alias("other"), F.col("head").alias("ohead"), F.col("label").alias("olabel"))
    )
    if not rest.isEmpty():
        meet = (F.col("k") == F.col("key")) & (F.col("olabel") != F.col("label")) & near("ohead")
        second = _probes(_table(labelled, segments), radius).join(rest, meet)
        links = links.unionByName(pin(second.select(*_ends("node", "other")).distinct()))
    return connected_components(links)


def simhash_groups(docs: DataFrame, width: int = 3, segments: int = 2, radius: int = 1, max_distance: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, text_hash, _fp, component_id.

    component_id is the least doc_id reachable over links, the row's own included. Null and wordless texts
    have fingerprint zero and link like any other; rows with a null doc_id take part and are named by the
    other members (null if there are none). Repeated rows and ties share a class. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_fingerprints(rows, width, 1, False).withColumn("text_hash", F.xxhash64(text_or_empty()))
    rows = pin(rows.select("doc_id", "text_hash", "_fp"))
    per_class = rows.groupBy(F.col("_fp")[0].alias("_f0")).agg(F.min("doc_id").alias("first_id"))
    classes = pin(per_class.select(F.monotonically_increasing_id().alias("node"), F.array("_f0").alias("_fp"), "first_id"))
    comps = hamming_components(classes.select("node", "_fp"), segments, radius, max_distance)
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "comp").select(F.col("_fp")[0].alias("_f0"), "component_id")
    return rows.withColumn("_f0", F.col("_fp")[0]).join(named, "_f0").select("doc_id", "text_hash", "_fp", "component_id")


def _shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles (of all words if they are fewer), mixed from those of the words."""
    import xxhash

    words = lower_ascii((text or "").encode("utf-8", "surrogatepass")).split()
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    mixed = np.full(len(words) - width + 1 if words else 0, width, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed + single[i : i + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _sums(levels: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Planes of bits, each of those at place k worth 2**k, added up until there is one at every place."""
    for k, planes in enumerate(levels):
        p = np.concatenate(planes)
        while len(p) > 1:
            n = max(len(p) // 3, 1)
            x, y, z = p[:n], p[n : 2 * n], p[2 * n : 3 * n]
            one, both = x ^ y, x & y
            if len(z):
                both, one = both | (one & z), one ^ z
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(both)
            p = np.concatenate([one, p[3 * n :]])
        levels[k] = [p]
    return levels


def shingle_fingerprint(text: str | None) -> bytes:
    """SimHash of the text's set of five-word shingles: a bit is set if it is set in over half of the shingles' hashes.

    Texts without words have a fingerprint of zeros.
    """
    hashes = _shingle_hashes(text)
    levels: list[list[np.ndarray]] = [[np.zeros((1, len(_SALTS)), dtype=np.uint64)]]
    for at in range(0, len(hashes), 512):
        bits = (hashes[at : at + 512, None] ^ _SALTS) * _MIX
        bits ^= bits >> np.uint64(32)
        bits *= _MIX
        bits ^= bits >> np.uint64(29)
        levels[0].append(bits)
        levels = _sums(levels)
    half = len(hashes) // 2
    more, equal = np.zeros(len(_SALTS), dtype=np.uint64), np.full(len(_SALTS), ~np.uint64(0))
    for k in reversed(range(max(len(levels), half.bit_length()))):
        plane = levels[k][0][0] if k < len(levels) else np.zeros_like(more)
        if half >> k & 1:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return more.astype("<u8").tobytes()


def _segments(raw: np.ndarray) -> np.ndarray:
    """Values of all segments of fingerprints, one row of bytes each."""
    parts = raw.reshape(len(raw), NEAR_SEGMENTS, NEAR_BITS // 8).astype(np.uint32)
    return parts[:, :, 0] << 16 | parts[:, :, 1] << 8 | parts[:, :, 2]


def shingle_keys(text: str | None) -> list[int]:
    """Segments under which a text is in the table, and those that it probes: one bit away, where it has the bit set.

    Texts that differ in at most one bit of a segment share one.
    """
    values = _segments(np.frombuffer(shingle_fingerprint(text), dtype=np.uint8)[None])[0]
    return [s << NEAR_BITS | (v ^ m) for s, v in enumerate(map(int, values)) for m in ball_masks(1, NEAR_BITS) if v & m == m]


def _meet(rows: np.ndarray, flips: list[int], own: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a shard that meet within one of the bits ``flips``, or in no bit (``own``): value, node, crowd.

    Pairs whose first bits differ in more than NEAR_MOST are left out. A row with over ``most`` rows in its ball is a crowd's and
    named under the fullest value there; pairs of two such rows are not looked at.
    """
    rows = rows[np.argsort(rows["value"], kind="stable")]
    value, node, first, second = (np.ascontiguousarray(x) for x in (rows["value"], rows["node"], rows["head"][:, 0], rows["head"][:, 1]))
    distinct, start, count = np.unique(value, return_index=True, return_counts=True)

    def held(near):
        at = np.minimum(np.searchsorted(distinct, near), len(distinct) - 1)
        return start[at], np.where(distinct[at] == near, count[at], 0)

    best, size, ball = value.copy(), np.zeros(len(value), dtype=np.int64), np.zeros(len(value), dtype=np.int64)
    for flip in [0, *flips]:
        near = value ^ np.uint32(flip)
        n = held(near)[1]
        ball += n
        best[n > size] = near[n > size]
        size = np.maximum(size, n)
    crowd = ball > most
    found = [(best[crowd], node[crowd])]
    for flip in [0, *flips] if own else flips:
        for at in range(0, len(value), 1 << 16):
            mine = np.arange(at, min(at + (1 << 16), len(value)))
            mine = mine[value[mine] & np.uint32(flip) == flip]
            low, n = held(value[mine] ^ np.uint32(flip))
            few = (n > (flip == 0)) & (n <= most)
            mine, low, n = mine[few], low[few], n[few]
            i = np.repeat(mine, n)
            j = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))
            apart = np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(second[i] ^ second[j])
            met = (apart <= NEAR_MOST) & (i != j) & ~(crowd[i] & crowd[j])
            found += [(value[j[met]], node[i[met]]), (value[j[met]], node[j[met]])]
    values, nodes = (np.concatenate(x) for x in zip(*found, strict=True))
    crowded = np.arange(len(values)) < int(crowd.sum())
    order = np.lexsort((nodes, values, crowded))
    values, nodes, crowded = values[order], nodes[order], crowded[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1]) | (crowded[1:] != crowded[:-1])
    return values[new], nodes[new], crowded[new]


def near_members(classes: DataFrame) -> DataFrame:
    """``classes(node long, _fp binary)``, nodes distinct -> ``(node, key, crowd)``: nodes by the segments in which they meet others.

    Every pair with at most one differing bit in a segment shares a key, or both nodes have a row of a crowd.
    """
    import pyarrow as pa

    n = classes.count()
    pieces, most = -(-n // SHARD_ROWS), CROWD + (4 * n * (NEAR_BITS + 1) >> NEAR_BITS)
    low = (1 << NEAR_BITS // 2) - 1
    # Bits that the shard depends on, bits that may differ within it.
    parts = [(0, low << NEAR_BITS // 2 | low)] if pieces <= 1 else [(low << NEAR_BITS // 2, low), (low, low << NEAR_BITS // 2)]
    pieces = max(pieces, 1)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            rows = np.empty(b.num_rows, dtype=_ROW)
            rows["node"], rows["head"] = b.column(0).to_numpy(), np.ascontiguousarray(raw[:, :16]).view("<u8")
            for s, value in enumerate(np.ascontiguousarray(_segments(raw).T)):
                rows["value"] = value
                shards, blobs = [], []
                for part, (fixed, _) in enumerate(parts):
                    piece = ((value & np.uint32(fixed)) * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(pieces)
                    for p in np.unique(piece):
                        shards.append((s * len(parts) + part) * pieces + int(p))
                        blobs.append(rows[piece == p].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "rows"])

    def meet(key, table):
        shard = key[0].as_py()
        part = shard // pieces % len(parts)
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), dtype=_ROW)
        flips = [1 << i for i in range(NEAR_BITS) if parts[part][1] >> i & 1]
        values, nodes, crowd = _meet(rows, flips, part == 0, most)
        keys = values.astype(np.int64) | (shard // (pieces * len(parts)) << NEAR_BITS) | crowd.astype(np.int64) << 62
        return pa.table({"node": nodes, "key": keys, "crowd": crowd})

    with short_lived_shuffles(classes.sparkSession):
        dealt = classes.select("node", "_fp").mapInArrow(deal, "shard long, rows binary")
        met = dealt.groupBy("shard").applyInArrow(meet, "node long, key long, crowd boolean")
        met = pin(met.distinct() if len(parts) > 1 else met)
        # Pairs within crowds are left to prefixes in every segment, also where few rows meet.
        dense = met.where("crowd").select("node", F.lit(True).alias("dense")).distinct()
        told = met.join(dense, "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
        needed = told.groupBy("key").agg(F.min("dense").alias("every"), F.max("crowd").alias("any")).where("any or not every").select("key")
        return pin(told.join(needed, "key").select("node", "key", "crowd"))


def bucket_components(members: DataFrame, verify, prefixes) -> DataFrame:
    """``members(node long, key long, crowd boolean)`` -> ``(node, comp)`` of the nodes linked by verified pairs that share a key.

    Turn 0 looks at the pairs of every key's members with one centre of that key. Members that are then of one
    component are done. Of the keys that still hold several components, those of SMALL members or fewer are joined
    in full, larger ones get another centre. Keys of crowds have turn 0 only. The nodes of large keys that stay mixed, and all nodes of crowds, get keys of another kind,
    ``prefixes(nodes)`` -> ``(node, key, pos, size)``: texts that agree in a common passage, or that just miss the similarity,
    hardly ever share one, while similar ones always do. What the last turn finds mixed is joined in full.
    Sets that share the key at ``pos`` of ``size`` and none before have no more in common than what follows in the
    shorter rest; only pairs for which that is too little are left out.
    """
    dense = pin(members.where("crowd").select("node").distinct())
    links, labels, at = None, None, members.select("node", "key", F.lit(0).alias("pos"), F.lit(0).alias("size"), F.col("node").alias("comp"), "crowd")
    theirs = ["pos", "size", "comp"]
    enough = F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos")) * (1 + LEAST_SIMILARITY) >= (F.col("size") + F.col("o_size")) * LEAST_SIMILARITY - 1e-6
    apart = (F.col("comp") != F.col("o_comp")) & enough
    for turn in range(TURNS):
        lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", *theirs)).alias("c")
        mixed = at.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead).where("lo <> hi")
        mixed = pin(mixed.select("key", "n", F.col("c.node").alias("other"), *(F.col(f"c.{c}").alias(f"o_{c}") for c in theirs)))
        if mixed.isEmpty() and (turn != TURNS - 3 or dense.isEmpty()):
            break
        last = turn == TURNS - 1
        full = F.lit(turn > 0) & ((F.col("n") <= SMALL) | F.lit(last))
        met = at.join(mixed.where(~full), "key").where(apart).select(*_ends("node", "other"))
        if turn:
            mine = at.join(mixed.where(full).select("key"), "key").select("key", "node", *theirs)
            others = mine.select("key", F.col("node").alias("other"), *(F.col(c).alias(f"o_{c}") for c in theirs))
            met = met.unionByName(mine.join(others, "key").where(F.col("node") < F.col("other")).where(apart).select(*_ends("node", "other")))
        found = verify(pin(met.distinct()))
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
        if last:
            break
        if not turn:
            at = at.where("not crowd")
        rest = at.join(mixed.where((F.col("n") > SMALL) | F.lit(turn == 0)).select("key"), "key").select("node", "key", "pos", "size")
        if turn == TURNS - 3:
            rest = prefixes(pin(rest.select("node").union(dense).distinct()))
        at = pin(rest.join(labels, "node", "left").select("node", "key", "pos", "size", F.coalesce("comp", "node").alias("comp")))
    return labels if labels is not None else members.select("node", F.col("node").alias("comp")).limit(0)


def _verifier(classes: DataFrame, docs: DataFrame, nodes: DataFrame):
    """Two functions over sets of shingle hashes, which the first call of ``verify`` fetches for all ``nodes(node)``.

    ``verify(links(a, b))``: the links whose texts have the similarity of near copies. ``prefixes(nodes)`` -> ``(node, key, pos, size)``: of every set the rarest shingles among these nodes, one more
    than a set may miss of a similar one. Similar sets share one of them, whatever else they hold.
    """
    held: list[DataFrame] = []

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_hashes(t).tobytes() for t in texts])

    @F.pandas_udf("array<long>")
    def unpacked(sets: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.int64) for x in sets])

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64)
            small, large = (p, q) if len(p) < len(q) else (q, p)
            if len(small) < LEAST_SIMILARITY * len(large):
                out.append(False)
                continue
            at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
            both = int((large[at] == small).sum()) if len(large) else 0
            either = len(p) + len(q) - both
            out.append(not either or both >= LEAST_SIMILARITY * either)
        return pd.Series(out, dtype="bool")

    def verify(links: DataFrame) -> DataFrame:
        if not held:
            wanted = classes.join(nodes, "node").select("node", F.col("sample.doc_id").alias("w_id"))
            texts = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64(text_or_empty()).alias("d_hash"), text_or_empty().alias("t"))
            # One row stands for a text, whatever the number of its copies; equal rows are told apart by nothing.
            met = texts.join(wanted, F.col("d_id").eqNullSafe(F.col("w_id")) & (F.col("d_hash") == F.col("node")))
            held.append(pin(met.groupBy("node").agg(F.min("t").alias("t")).select("node", shingles("t").alias("set"))))
        left, right = (held[0].select(F.col("node").alias(e), F.col("set").alias(f"set_{e}")) for e in "ab")
        return pin(links.join(left, "a").join(right, "b").where(similar("set_a", "set_b")).select("a", "b"))

    def prefixes(nodes: DataFrame) -> DataFrame:
        each = held[0].join(nodes, "node").select("node", F.explode(unpacked("set")).alias("key"))
        counted = each.join(each.groupBy("key").agg(F.count("*").alias("f")), "key")
        ranked = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("s"))
        size = F.size("s")
        missing = size - F.ceil(size * F.lit(LEAST_SIMILARITY) - F.lit(1e-9)).cast("int")
        return ranked.select("node", size.alias("size"), F.posexplode(F.slice("s", F.lit(1), missing + 1)).alias("pos", "p")).where("p.f > 1").select("node", "p.key", "pos", "size")

    return verify, prefixes


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, comp per row of ``docs(doc_id, text, ...)``: comp is a text's hash, no doc_id; equal texts are one node."""

    @F.pandas_udf("binary")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_fingerprint(t) for t in texts])

    rows = pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), prints(text_or_empty()).alias("_fp")))
    sample = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("sample")
    classes = pin(rows.groupBy(F.col("text_hash").alias("node")).agg(F.first("_fp").alias("_fp"), sample))
    members = near_members(classes)
    comps = bucket_components(members, *_verifier(classes, docs, members.select("node").distinct()))
    named = comps.select(F.col("node").alias("text_hash"), "comp")
    return rows.select("doc_id", "text_hash").join(named, "text_hash", "left").select("doc_id", "text_hash", F.coalesce("comp", "text_hash").alias("comp"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group left, all columns kept: that of the least doc_id (null last).

    Near copies share LEAST_SIMILARITY or more of their five-word shingles. Wordless texts are one group. Of
    repeated rows one stays. Extra columns may have any name.
    """
    groups = pin(near_copy_groups(docs))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = groups.groupBy("comp").agg(F.min(order).alias("o"))
    chosen = first.select(F.col("o.doc_id").alias("_ndk_id"), F.col("o.text_hash").alias("_ndk_hash"))
    repeated = groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_ndr_id"), F.col("text_hash").alias("_ndr_hash"))
    chosen = pin(chosen.join(repeated, F.col("_ndk_id").eqNullSafe(F.col("_ndr_id")) & (F.col("_ndk_hash") == F.col("_ndr_hash")), "left").select("_ndk_id", "_ndk_hash", F.col("_ndr_hash").isNotNull().alias("_ndk_many")))
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64(text_or_empty())
    kept = docs.join(chosen, id_.eqNullSafe(F.col("_ndk_id")) & (hash_ == F.col("_ndk_hash")))
    names = docs.columns
    single = kept.where("not _ndk_many").select(*names)
    many = kept.where("_ndk_many").dropDuplicates(["_ndk_id", "_ndk_hash"]).select(*names)
    return single.unionByName(many)


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = simhash_groups(docs)
    return groups.select("doc_id", F.lpad(F.lower(F.hex(F.col("_fp")[0])), 16, "0").alias("fingerprint"), "component_id")
