"""WebP streams, page extraction, chat formatting, the pipeline."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st

from lodestack.llm import chat, html, webp
from lodestack.llm.html_train import examples


def picture(seed, n=64 * 16, colours=None):
    r = np.random.default_rng(seed)
    px = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    return px if colours is None else px[r.integers(0, colours, n)]


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 17, 300, None])
def test_encoder_round_trip(colours):
    px = picture(3, 4096, colours)
    px[100:140] = px[99]
    out, w, h = webp.decode_many([webp.encode(px, 16)])[0]
    assert (w, h) == (16, 256) and np.array_equal(out, px)


@hyp(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=900), st.booleans(), st.sampled_from([0, 1, 5, 11]))
def test_streams_round_trip_both_ways(data, own, bits):
    px = np.frombuffer(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), "<u4")
    bits = bits if own else 0
    h, k, code, n = webp.encode_stream(px, own, bits)
    stream = webp.pack_bits(h, k, code, n) + b"\0" * 16
    r = webp.BitReader(stream)
    cache = r.read(4) if r.read(1) else 0
    assert cache == bits and r.read(1) == 0
    got = webp._tokens_one(r, [webp._read_group(r, cache)], None, 0, cache, 16, len(px) // 16)
    assert np.array_equal(got, px)


def file_with(transforms, px, width, own=True):
    """A file whose transforms (bits to write, after the pixels were changed accordingly) come before the image."""
    head, n = webp._image_head(width, len(px) // width)
    for value, bits in transforms:
        head |= value << n
        n += bits
    h, k, code, lens = webp.encode_stream(px, own, 0)
    return webp._container(webp.pack_bits(head | h << (n + 1), n + 1 + k, code, lens))


def sub_image(px):
    h, n, code, bits = webp.encode_stream(np.asarray(px, dtype=np.uint32), True)
    h, n = (h & 1) | (h >> 2 << 1), n - 1
    return int.from_bytes(webp.pack_bits(h, n, code, bits), "little"), n + int(bits.sum())


def test_subtract_green():
    px = picture(5)
    c = px.view(np.uint8).reshape(-1, 4).copy()
    c[:, 0] -= c[:, 1]
    c[:, 2] -= c[:, 1]
    f = file_with([(1 | webp.SUBTRACT_GREEN << 1, 3)], c.view("<u4").ravel(), 32)
    assert np.array_equal(webp.decode_many([f])[0][0], px)


def test_cross_colour():
    width, px = 32, picture(6)
    height = len(px) // width
    blocks = picture(7, (width // 4) * (height // 4))
    e, v = webp._spread(blocks, 2, width, height).astype(np.int64), px.astype(np.int64)
    green, red = v >> 8 & 255, v >> 16 & 255
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int64)
    less_red = red - (signed(e & 255) * signed(green) >> 5) & 255
    less_blue = (v & 255) - (signed(e >> 8 & 255) * signed(green) >> 5) - (signed(e >> 16 & 255) * signed(red) >> 5) & 255
    changed = (v & 0xFF00FF00 | less_red << 16 | less_blue).astype(np.uint32)
    f = file_with([(1 | webp.CROSS_COLOUR << 1, 3), (0, 3), sub_image(blocks)], changed, width)
    assert np.array_equal(webp.decode_many([f])[0][0], px)


def test_predictors():
    width, px = 16, picture(8, 16 * 56)
    modes = np.arange(4 * 14) % 14
    blocks = (modes << 8).astype(np.uint32)
    per_pixel = (webp._spread(blocks, 2, width, 56) >> 8).tolist()
    flat = px.view(np.uint8).reshape(-1, 4).astype(int).tolist()
    res = []
    for i, c in enumerate(flat):
        x, y = i % width, i // width
        p = [0, 0, 0, 255] if i == 0 else flat[i - 1] if y == 0 else flat[i - width] if x == 0 else webp.predict(per_pixel[i], flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        res.append([(a - b) & 255 for a, b in zip(c, p, strict=True)])
    residual = np.array(res, dtype=np.uint8).reshape(-1).view("<u4")
    f = file_with([(1 | webp.PREDICTOR << 1, 3), (0, 3), sub_image(blocks)], residual, width)
    assert np.array_equal(webp.decode_many([f])[0][0], px)


def test_distances_and_values():
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7) and len(webp.NEAR) == 120
    for v in range(1, 5000):
        s, extra, n = webp._value_prefix(v)
        w = webp.BitWriter()
        w.write(extra, n)
        assert webp._extra(webp.BitReader(w.value.to_bytes(8, "little")), s) == v


def test_back_references_overlap():
    kinds, values = np.array([0, 0, 1, 0, 1]), np.array([7, 8, 0, 9, 0])
    out = webp.resolve(kinds, values, np.array([1, 1, 5, 1, 3]), np.array([0, 0, 2, 0, 4]), 0, 11)
    assert out.tolist() == [7, 8, 7, 8, 7, 8, 7, 9, 7, 8, 7]
    with pytest.raises(ValueError):
        webp.resolve(np.array([1]), np.array([0]), np.array([1]), np.array([5]), 0, 1)


def test_bad_files_are_refused():
    with pytest.raises(ValueError):
        webp.decode_many([b"RIFFxxxxWEBPVP8 "])


def test_labeller_on_pages_it_has_not_seen():
    data = examples(150, 10**7)
    found = html.Labeller.load().probabilities([x for x, _ in data])
    assert np.mean(np.concatenate([(p > 0.5) == (y > 0.5) for p, (_, y) in zip(found, data, strict=True)])) > 0.97


def test_blocks():
    page = '<head><title>t</title></head><body><script>x("</p>")</script><p>a <b>b</b>&nbsp;&amp; c<p>d<br>e<ul><li>f<li>g</ul><!-- h --><div>i'
    assert [b.text for b in html.blocks(page)] == ["a b & c", "d e", "f", "g", "i"]
    assert html.blocks(None) == [] and html.blocks("") == []


def test_extract(spark):
    article = "<article><h1>Title words</h1><p>First &eacute; paragraph of text.</p><p>Second one.</p></article>"
    page = f'<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>{article}<div class="comments"><p>Nice one!</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", None), (None, "u", page.replace("Second one.", "word " * 30000), "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "Title words\n\nFirst é paragraph of text.\n\nSecond one."
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(want) - 11 + 30000 * 5 - 1), (1, len(want)), (1, len(want)), (2, 0), (3, 0)]
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def conversation(cid, turns):
    return [(cid, i, r, t, "x") for i, (r, t) in enumerate(turns)]


def test_chat(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", "c <|im_end|>")]
    rows = conversation(1, long[:1]) + conversation(2, long[:2]) + conversation(3, long) + conversation(4, long) + conversation(5, [("user", "a"), ("assistant", None)]) + conversation(6, [(None, "a")]) + conversation(7, [("user", f"t{i}") for i in range(300)]) + [(None, None, "user", "z", "x")]
    schema = "conv_id long, turn long, role string, text string, copies string"
    got = {(r.conv_id, r.part): r for r in chat.format_chats(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert set(got) == {(3, 0), (5, 0), (6, 0), (7, 0), (7, 1), (None, 0)}
    assert got[3, 0].copies == 2 and got[3, 0].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc < |im_end| ><|im_end|>\n"
    assert got[7, 0].text.count("<|im_start|>") == 256 and got[7, 1].n_turns == 300
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_pipeline_run_equals_its_stages_by_hand(spark, tmp_path):
    """run() on a small table; near copies by all pairs, rules and languages row by row, tokens by the tokenizer."""
    import random
    from collections import Counter

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestack.llm import langid, mixing, quality

    r = random.Random(8)
    de = "der alte fluss trägt kleine boote unter steinernen brücken zu den fernen städten und jeden morgen kommt salz".split()
    en = "the river bends under old stone bridges while small boats carry salt and grain toward distant harbour towns".split()
    texts = [" ".join(r.choices(de if i % 4 == 0 else en, k=r.randint(30, 120))) for i in range(40)]
    copies = [(" ".join([*t.split()[:-2], "other", "end"])) for t in texts[:10]] + texts[10:15] + ["was " * 60, "", "12 34"]
    rows = [(i, t, "de" if i % 40 % 4 == 0 else "en", "ab"[i % 3 == 0], len(t)) for i, t in enumerate(texts + copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {x.doc_id for x in quality.quality_rules(docs).where("kept").collect()}
    kept = docs.where(docs.doc_id.isin(list(good)))
    classify = langid.Classifier(langid.train(kept.select("lang", "text")))
    told = {i: t for i, t, *_ in rows if i in good and classify(t)[0] != "und" and classify(t)[1] >= langid.LEAST_MARGIN}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    root = {i: i for i in told}
    for i in told:
        for j in told:
            a, b = shingles(told[i]), shingles(told[j])
            if i < j and len(a & b) >= 0.8 * len(a | b):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    single = docs.where(docs.doc_id.isin(sorted(set(root.values()))))
    times = Counter({x.doc_id: x.copies for x in mixing.mix(single).collect()})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({i: n * (1 + len(tokenizer.encode(told[i], add_special_tokens=False).ids)) for i, n in times.items() if n})
    packed = Counter()
    for x in got:
        packed[x.doc_id] += x.length
    assert packed == want and len(set(root.values())) < len(told) < len(rows)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><meta charset=u><title>t</title><body><article><p>one<p>two", ["one", "two"]),
        ("<html><head><title>t</title><article><p>one</p></article>", ["one"]),
        ("<head><meta>one<p>two", ["one", "two"]),
        ("<head>x<title>t</title></head><p>one", ["one"]),
        ("<p>a <svg class=i/> one.</p><p>two", ["a one.", "two"]),
        ('<p>a<svg class="i" /><math/> b</p><svg><path/><svg>x</svg>y</svg><p>c', ["a b", "c"]),
        ("<svg><title/><path d=x></svg><p>one</p><svg><text>no<p>two", ["one", "two"]),
        ("<div><select><option>x<option>y<p>one</p></div><p>two<select><option>z</select>", ["one", "two"]),
        ("<object data=x><p>one</p><video src=y><p>two", ["one", "two"]),
        ("<!--><p>one<!-- x --!><p>two<!-- rest", ["one", "two"]),
        ("<p>one<script>if (a < b) '</p>'", ["one"]),
    ],
)
def test_left_out_elements_do_not_swallow_the_page(page, want):
    assert [b.text for b in html.blocks(page)] == want
