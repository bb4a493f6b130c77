"""Operators on documents against brute force, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import langid, media, mixing, ngram, packing, quality, simhash, tokencount
from lodestack.llm.components import connected_components
from lodestack.llm.tokens import encoder


def lowered(t):
    return (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def fingerprint(t):
    import xxhash

    w = lowered(t)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    """Union-find over all pairs."""
    up = list(range(len(items)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 1), (None, 1), (4, 5)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_balls_meet_every_pair_once():
    masks = simhash.ball_masks(2, 6)
    for x in range(64):
        for y in range(x):
            d = bin(x ^ y).count("1")
            if d <= 2:
                met = [m for a, b in ((x, y), (y, x)) for m in masks if a ^ m == b and (m == 0 or a & m & -m)]
                assert len(met) == 1


def test_simhash(docs, empty):
    rows = docs.collect()
    got = simhash.simhash_groups(docs).collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    assert len(got) == len(rows)
    assert all(r._fp[0] % (1 << 64) == prints[r.doc_id] for r in got)
    root = groups(rows, lambda a, b: bin(prints[a.doc_id] ^ prints[b.doc_id]).count("1") <= 3)
    least = {}
    for r, g in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, 1 << 60), r.doc_id)
    want = Counter((r.doc_id, least.get(g)) for r, g in zip(rows, root, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_second_round_finds_links_that_centres_miss(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ (7 << 40), base ^ (7 << 40) ^ 7, base ^ (7 << 40) ^ 7 ^ (7 << 8), base ^ 0xFF]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(i, [f]) for i, f in enumerate(signed)], "node long, _fp array<long>")
    got = {r.node: r.comp for r in simhash.hamming_components(classes, 2, 1, 3).collect()}
    root = groups(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(root))


def test_near_duplicates_keep_one_of_each_group(docs, empty):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # Null, empty and blank texts are one group; 3 and 4, 5 to 7 are copies; 8 is repeated.
    assert ids == Counter([0, 3, 5, 8, 9, 10, 11, 12, 13, 14, 15, 16, None])
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_media(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in media.media_column(docs, keep_media=True).collect():
        raw = (texts[r.doc_id] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        padded = raw.ljust(size, b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), size)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert media.load([bytes(r.media)]) == [padded]
    assert media.media_column(empty).count() == 0


def test_language(spark, docs, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 16))
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert got[14].lang_pred == "de" and got[5].lang_pred == "en"
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {0, 1, 2, 16} & {r.doc_id for r in kept.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def measures(t):
    w = (t or "").encode().split()
    w = [x.decode() for x in w]
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        n, *_, rep = m = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    assert not next(r for r in got if r.doc_id == 13).kept and next(r for r in got if r.doc_id == 5).kept
    assert quality.quality_rules(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_buckets_keep_six_leading_bits(spark):
    values = [0, 1, 31, 63, 64, 65, 127, 128, 1000, 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v"))).collect()]
    assert got == [v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6) for v in values]


def test_lm(docs, empty):
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows}
    c = Counter()
    for r in rows:
        if not held[r.doc_id]:
            c.update([*lowered(r.text), b" "])
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in rows}
    got = ngram.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = [*lowered(texts[r.doc_id]), b" "]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[x] > 0 for x in t), n, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert r.score < 0
    assert ngram.lm_scores(empty).count() == 0


class BackoffModel:
    """Probabilities by the formula, over dictionaries of words; no automaton, hashes or blocks."""

    def __init__(self, texts):
        self.c = Counter()
        for t in texts:
            seq = ["", *t, ""]
            self.c.update((w,) for w in seq[1:])
            self.c.update(zip(seq, seq[1:], strict=False))
            self.c.update(k for k in zip(seq, seq[1:], seq[2:], strict=False) if k[1] != "")
        single = [c for k, c in self.c.items() if len(k) == 1]
        self.base = sum(single) + len(single) + 1

    def p(self, history, w):
        if not history:
            return (self.c[(w,)] + 1) / self.base
        return (self.c[(*history, w)] + ngram.PRIOR * self.p(history[1:], w)) / (self.c[history] + ngram.PRIOR)

    def score(self, t):
        seq = ["", *t, ""]
        return sum(np.log10(self.p(tuple(seq[max(0, i - 2) : i]), seq[i])) for i in range(1, len(seq)))


def zipf_texts(r):
    words = [f"w{i}" for i in range(60)]
    texts = [[words[min(int(r.expovariate(0.15)), 59)] for _ in range(r.randint(0, 60))] for _ in range(120)]
    return [*texts, [], texts[0] * 40, ["never", "seen"], ["w0"]]


@pytest.mark.parametrize("block, shard", [(ngram.BLOCK, ngram.SHARD), (300, 500)])
def test_scores_equal_a_backoff_model_without_automaton(spark, monkeypatch, block, shard):
    import random

    monkeypatch.setattr(ngram, "BLOCK", block)
    monkeypatch.setattr(ngram, "SHARD", shard)
    texts = zipf_texts(random.Random(5))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model = BackoffModel([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {x.doc_id: x.score for x in ngram.lm_scores(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(model.score(t), abs=1e-6), i


def test_automaton_is_a_distribution_and_lanes_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [[*rng.integers(1, 7, k).tolist(), 0] for k in (1, 3, 700, 1500)]
    symbols, sizes = np.concatenate(texts), [len(t) for t in texts]
    keys, third = ngram.ngram_keys(symbols, np.arange(7, dtype=np.uint64) * np.uint64(12345) + np.uint64(99))
    _, places, counts = np.unique(keys, return_inverse=True, return_counts=True)
    auto, one = ngram._automaton(symbols, counts, places, third, len(symbols), 7)
    assert one.tolist() == np.bincount(symbols)[symbols].tolist()
    for s in {0, *auto.after.tolist(), *auto.next.tolist()}:
        gain, _ = auto.step(np.full(7, s), np.arange(7))
        assert np.sum(10.0**gain) == pytest.approx(1, abs=1 / len(symbols))
    want = []
    for t in texts:
        state, total = np.array([auto.start]), 0.0
        for w in t:
            gain, state = auto.step(state, np.array([w]))
            total += gain[0]
        want.append(total)
    monkeypatch.setattr(ngram, "LANE", 100)
    assert auto.score(symbols, np.cumsum(sizes)) == pytest.approx(want)


def reference_ids(texts, literal=False):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = literal
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_encoder_equals_the_tokenizer(docs):
    texts = [r.text for r in docs.collect()] + ["ΟΔΟΣ Σ. a\x1cb", "x" * 4000, "12'rea'v é ́x", "don't IT'S <|endoftext|>"]
    for literal in (False, True):
        got = encoder(literal=literal).encode([None if t is None else t.encode() for t in texts])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == reference_ids(texts, literal)


def test_packing(docs, empty):
    rows = docs.collect()
    ids = {r.doc_id: np.array([*i, 2], dtype="<u4") for r, i in zip(rows, reference_ids([r.text for r in rows]), strict=True)}
    got = packing.pack(docs).collect()
    seqs, tokens = {}, Counter()
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    for k, pieces in seqs.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 4096 or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    assert tokens == sum((Counter({r.doc_id: len(ids[r.doc_id])}) for r in rows), Counter())
    assert packing.pack(empty).count() == 0


def test_windows_keep_to_proportions(spark):
    # Long documents, a queue of few long ones, a null source and sources below a queue of their own.
    rows = [(i, "w " * (4000 if i % 50 == 0 else 40 + i % 7), "ab"[i % 4 == 0]) for i in range(1200)]
    rows += [(2000 + i, "x " * 9000, None) for i in range(3)] + [(3000 + i, "y z", f"rare{i}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {r[0]: "rare" if (r[2] or "").startswith("rare") else r[2] for r in rows}
    per, total = {}, Counter()
    for r in packing.pack(d).collect():
        per.setdefault(r.sequence_id, Counter())[source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    every = sum(total.values())
    assert sum(per[max(per)].values()) == every - 4096 * max(per)
    for k, held in per.items():
        if k != max(per):
            assert sum(held.values()) == 4096
            assert all(abs(held[s] - 4096 * n / every) <= 2 for s, n in total.items() if s != "rare")


def test_schedule_covers_every_token_once():
    rng = np.random.default_rng(3)
    for trial in range(30):
        sizes = rng.integers(1, 60_000, rng.integers(1, 9))
        sizes = sizes[sizes * 4096 >= packing.LEAST_QUANTUM * sizes.sum()]
        rounds = packing.Rounds(np.cumsum(sizes))
        seen = np.zeros(int(sizes.sum()), dtype=int)
        for q, size in enumerate(sizes.tolist()):
            cuts = np.unique(np.concatenate([[0, size], rng.integers(0, size, 5)]))
            n, place = np.diff(cuts), cuts[:-1]
            doc, start, length, window, offset = rounds.pieces(np.full(len(n), q), place, n)
            assert (np.bincount(doc, weights=length, minlength=len(n)) == n).all()
            assert ((offset >= 0) & (offset + length <= 4096)).all()
            for w, o, k in zip(window.tolist(), offset.tolist(), length.tolist(), strict=True):
                seen[w * 4096 + o : w * 4096 + o + k] += 1
        assert (seen == 1).all()


def test_mixing(docs, empty):
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    got = mixing.mix(docs).collect()
    per, target = Counter(), {}
    for r in got:
        assert r.size == sizes[r.doc_id] and r.taken == r.copies * r.size and r.copies <= 3
        per[r.source] += r.taken
        target[r.source] = r.target
    total = sum(r.size for r in got)
    assert sum(target.values()) == pytest.approx(total)
    for s, t in target.items():
        assert abs(per[s] - t) <= max(r.size for r in got if r.source == s)
    again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_longer_documents_are_taken_more_often(spark):
    rows = [(i, "w " * (20 if i % 2 else 200), "ab"[i % 4 > 1]) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    per, taken, target = Counter(), Counter(), {}
    for r in got:
        per[r.source, r.size] += r.copies
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 100 for s, t in target.items())
    assert all(per[s, 200] > 1.1 * per[s, 20] > 0 for s in target)


def test_a_long_border_document_is_passed_over_once(spark):
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(1000, "w " * 900, "a"), (2000, "w " * 6000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert abs(sum(r.taken for r in got if r.source == "a") - next(r.target for r in got if r.source == "a")) <= 450


def test_targets_reshare_what_caps_leave(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 1000)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left = 3010 - 30
    assert got["a"] == 30 and got["b"] == pytest.approx(left * 2 / 8) and got["c"] == pytest.approx(left / 8) and got[None] == pytest.approx(left * 5 / 8)


def test_token_counts(docs, empty, monkeypatch):
    rows = docs.collect()
    want = Counter((r.doc_id, len(i)) for r, i in zip(rows, reference_ids([r.text for r in rows], True), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in tokencount.token_counts(docs).collect()) == want
    assert tokencount.token_counts(empty).count() == 0


def test_scan_stitches_blocks_and_reports_open_ends(spark, tmp_path):
    sep = tokencount.SEPARATOR
    ids = np.array([1, 2, sep, sep, *range(1, 30), sep, 5, 6, 7], dtype="<u2")
    (tmp_path / "t.bin").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(str(tmp_path / "t.bin"), len(ids) * 2), (str(tmp_path / "none.bin"), 0)], "path string, bytes long")
    for block in (2, 6, 10, 1 << 20):
        got = sorted((r.ordinal, r.n_tokens, r.complete) for r in tokencount.scan_token_files(files, str(tmp_path), block_bytes=block).collect())
        assert got == [(0, 2, True), (1, 0, True), (2, 29, True), (3, 3, False)]


def near_copies(seed, n=240):
    """A text and copies of it edited in one place, at scattered places, at the front and by leaving out."""
    import random

    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.9)) % 5000}" for _ in range(4000)]
    base = r.choices(vocabulary, k=n)
    k = r.randint(1, n // 5 - 1)
    new = [f"n{seed}x{i}" for i in range(k)]
    few = list(base)
    for i in r.sample(range(n), max(1, k // 10)):
        few[i] = f"s{seed}x{i}"
    return base, {"appended": base + new, "prepended": new + base, "substituted": few, "shortened": base[: n - k]}


def shingle_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_every_kind_are_met():
    met = Counter()
    for seed in range(250):
        base, edited = near_copies(seed)
        keys = set(simhash.shingle_keys(" ".join(base)))
        for kind, other in edited.items():
            j = shingle_similarity(base, other)
            if 0.8 <= j < 1:
                met[kind, min(int(j * 20), 19) / 20, bool(keys & set(simhash.shingle_keys(" ".join(other))))] += 1
    print(sorted(met.items()))
    for kind in ("appended", "prepended", "substituted", "shortened"):
        hit, missed = (sum(c for k, c in met.items() if k[0] == kind and k[2] is x) for x in (True, False))
        assert hit > 100 and missed <= 0.01 * hit


def test_near_duplicate_groups_are_those_of_all_pairs(spark):
    rows = []
    for seed in range(12):
        base, edited = near_copies(seed, 60)
        rows += [" ".join(t) for t in (base, *edited.values())]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    root = groups(rows, lambda a, b: shingle_similarity(a.split(), b.split()) >= 0.8)
    got = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert got == set(root) and len(got) < len(rows)


def test_languages_of_copies_get_their_full_sample(spark):
    text = F.concat(F.lit("text number "), (F.col("id") % 5).cast("string"), F.lit(" of "), F.col("lang"))
    langs = spark.createDataFrame([(f"l{i}",) for i in range(3)], "lang string")
    content = langid.train(spark.range(20000).crossJoin(langs).select("lang", text.alias("text")))
    assert {k: sorted(v.split(b"\n")) for k, v in content.items()} == {f"l{i}": [b"text number %d of l%d" % (k, i) for k in range(5)] for i in range(3)}


def test_all_sampled_texts_are_learned(spark):
    texts = [hashlib.shake_256(b"%d" % i).hexdigest(512) for i in range(400)]
    content = langid.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"))
    assert len(content["x"]) == 400 * 1025 - 1
    classify = langid.Classifier(content)
    assert max(classify.sizes(t)[0] for t in texts) < 100


def test_groups_with_clashing_or_null_ids_stay_apart(spark):
    a, b, c = (near_copies(seed, 60) for seed in (101, 102, 103))
    rows = [(1, a[0]), (1, b[0]), (2, b[1]["substituted"]), (None, c[0]), (None, c[1]["substituted"]), (None, near_copies(104, 60)[0])]
    assert all(shingle_similarity(x[0], x[1]["substituted"]) >= 0.8 for x in (b, c))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = simhash.drop_near_duplicates(docs).collect()
    assert {" ".join(t) for t in (a[0], b[0])} == {r.text for r in got if r.doc_id == 1}
    assert Counter(r.doc_id for r in got) == {1: 2, None: 2}


def bits(text):
    return np.unpackbits(np.frombuffer(simhash.shingle_fingerprint(text), dtype=np.uint8))


def test_shingle_fingerprints_are_majorities_of_hashes():
    for n in (0, 1, 4, 5, 6, 9, 700, 1500):
        hashes = simhash._shingle_hashes(" ".join(f"w{i}" for i in range(n)))
        ones = np.zeros(simhash.NEAR_SEGMENTS * simhash.NEAR_BITS, dtype=np.int64)
        for h in hashes:
            z = (h ^ simhash._SALTS) * simhash._MIX
            z = (z ^ z >> np.uint64(32)) * simhash._MIX
            ones += np.unpackbits((z ^ z >> np.uint64(29)).astype("<u8").view(np.uint8))
        assert (bits(" ".join(f"w{i}" for i in range(n))) == (2 * ones > len(hashes))).all()


@pytest.mark.parametrize("shard_rows", [1000, 20])
def test_near_copies_meet_by_hamming_balls_around_segments(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    texts = [" ".join(t) for seed in range(12) for base, edited in [near_copies(seed, 60)] for t in (base, *edited.values())]
    prints = [bits(t) for t in texts]
    classes = spark.createDataFrame([(i, bytearray(simhash.shingle_fingerprint(t))) for i, t in enumerate(texts)], "node long, _fp binary").repartition(3)
    by_key = {}
    for r in simhash.near_members(classes).collect():
        assert not r.crowd
        by_key.setdefault(r.key, set()).add(r.node)
    met = {(a, b) for nodes in by_key.values() for a in nodes for b in nodes if a < b}
    want = set()
    for b in range(len(texts)):
        for a in range(b):
            differ = prints[a] != prints[b]
            if differ.reshape(simhash.NEAR_SEGMENTS, -1).sum(1).min() <= 1 and differ[:128].sum() <= simhash.NEAR_MOST:
                want.add((a, b))
    assert want and want <= met
    assert all(shingle_similarity(texts[a].split(), texts[b].split()) < 0.8 for b in range(len(texts)) for a in range(b) if (a, b) not in met)


@pytest.mark.parametrize("shard_rows", [1000, 20])
def test_crowds_of_near_copies_are_those_of_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    import random

    r, rows = random.Random(3), []
    for group, edits in ((0, 2), (1, 9)):
        base = [f"g{group}w{i}" for i in range(150)]
        for copy in range(70):
            words = list(base)
            for i in r.sample(range(150), r.randint(0, edits)):
                words[i] = f"x{group}y{copy}z{i}"
            rows.append(" ".join(words))
    rows.append(" ".join(rows[0].split()[:135]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    fingerprinted = spark.createDataFrame([(i, bytearray(simhash.shingle_fingerprint(t))) for i, t in enumerate(dict.fromkeys(rows))], "node long, _fp binary")
    assert simhash.near_members(fingerprinted).where("crowd").count() > 0
    root = groups(rows, lambda a, b: shingle_similarity(a.split(), b.split()) >= 0.8)
    assert {d.doc_id for d in simhash.drop_near_duplicates(docs).collect()} == set(root)
