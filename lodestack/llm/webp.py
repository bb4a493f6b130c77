"""Lossless WebP (VP8L) in numpy: a decoder of the whole bitstream and an encoder that uses its tools.

Decoding: prefix codes are read into tables; the symbols of many images are then decoded in lockstep, one
lane per image, into tokens (literal, back-reference, colour-cache entry); tokens become pixels by
pointer doubling; predictor, cross-colour, subtract-green and palette transforms are inverted last.
Images with several prefix-code groups, and the small images inside transforms, are read one by one.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERAL, COPY, CACHED = range(3)
#: Order in which lengths of the code-length code are stored; fixed by the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_MUL = 0x1E35A7BD
#: Near pixels by distance, then by column offset: codes 1 to 120 of a back-reference's distance.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return (int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.pos += n
        return v


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


# ---- prefix codes -------------------------------------------------------------------------------


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bit-reversed as they stand in the stream."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if not n:
            continue
        code <<= n - last
        last = n
        codes[s] = int(format(code, f"0{n}b")[::-1], 2)
        code += 1
    return codes


class PrefixCode:
    """table[bits] = symbol << 4 | length, over ``width`` bits."""

    __slots__ = ("table", "width")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.width, self.table = 0, np.array([int(used[0]) << 4 if len(used) else 0], dtype=np.int64)
            return
        self.width = int(lengths.max())
        self.table = np.zeros(1 << self.width, dtype=np.int64)
        codes = _reversed_codes(lengths)
        for s in used.tolist():
            n = int(lengths[s])
            self.table[int(codes[s]) :: 1 << n] = s << 4 | n

    def read(self, r: BitReader) -> int:
        e = int(self.table[r.peek(self.width)])
        r.pos += e & 15
        return e >> 4


def _read_code(r: BitReader, size: int) -> PrefixCode:
    lengths = np.zeros(size, dtype=np.int64)
    if r.read(1):
        two = r.read(1)
        lengths[r.read(8 if r.read(1) else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return PrefixCode(lengths)
    first = np.zeros(19, dtype=np.int64)
    for i in range(4 + r.read(4)):
        first[LENGTH_ORDER[i]] = r.read(3)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    code, at, last = PrefixCode(first), 0, 8
    while at < size and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        n = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
        if s == 16:
            lengths[at : at + n] = last
        at += n
    return PrefixCode(lengths)


def code_lengths(weights: np.ndarray, most: int = 11) -> np.ndarray:
    """Huffman lengths of at most ``most`` bits; a lone symbol gets length 1."""
    lengths = np.zeros(len(weights), dtype=np.int64)
    used = np.flatnonzero(weights)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    floor = 0.0
    while True:
        heap = [(max(float(weights[s]), floor), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used.tolist(), 0)
        parts = {int(s): [int(s)] for s in used}
        tie = len(weights)
        nodes = [(w, s) for w, s, _ in heap]
        heapq.heapify(nodes)
        while len(nodes) > 1:
            (wa, a), (wb, b) = heapq.heappop(nodes), heapq.heappop(nodes)
            merged = parts.pop(a) + parts.pop(b)
            for s in merged:
                depth[s] += 1
            parts[tie] = merged
            heapq.heappush(nodes, (wa + wb, tie))
            tie += 1
        if max(depth.values()) <= most:
            break
        floor = max(floor * 2, float(weights[used].sum()) / (1 << most))
    for s, d in depth.items():
        lengths[s] = d
    return lengths


def _write_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) == 0 or (len(used) <= 2 and used[-1] < 256):
        w.write(1, 1)
        w.write(int(len(used) == 2), 1)
        w.write(1, 1)
        w.write(int(used[0]) if len(used) else 0, 8)
        if len(used) == 2:
            w.write(int(used[1]), 8)
        return
    ops: list[tuple[int, int, int]] = []
    at, last, values = 0, 8, lengths.tolist()
    while at < len(values):
        v, n = values[at], 1
        while at + n < len(values) and values[at + n] == v:
            n += 1
        at += n
        if v:
            if v != last:
                ops.append((v, 0, 0))
                n -= 1
                last = v
            while n >= 3:
                k = min(n, 6)
                ops.append((16, k - 3, 2))
                n -= k
            ops += [(v, 0, 0)] * n
        else:
            while n >= 3:
                k = min(n, 138)
                ops.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                n -= k
            ops += [(0, 0, 0)] * n
    first = code_lengths(np.bincount([o[0] for o in ops], minlength=19), 7)
    codes = _reversed_codes(first)
    lone = len(np.flatnonzero(first)) == 1
    w.write(0, 1)
    w.write(15, 4)
    for s in LENGTH_ORDER:
        w.write(int(first[s]), 3)
    w.write(0, 1)
    for s, extra, bits in ops:
        if not lone:
            w.write(int(codes[s]), int(first[s]))
        w.write(extra, bits)


# ---- encoder ------------------------------------------------------------------------------------


def _value_prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or a distance code, from 1 on."""
    if v <= 4:
        return v - 1, 0, 0
    d = v - 1
    top = d.bit_length() - 1
    second = d >> (top - 1) & 1
    return 2 * top + second, d & ((1 << (top - 1)) - 1), top - 1


def _text_weights() -> np.ndarray:
    """Weights of byte values in text, by class."""
    w = np.full(256, 0.02)
    w[0x80:0xC0], w[0xC3] = 0.4, 4.0
    w[ord("A") : ord("Z") + 1], w[ord("0") : ord("9") + 1] = 0.5, 0.5
    w[ord("a") : ord("z") + 1], w[[ord(c) for c in ".,\n|"]] = 4.0, 2.0
    w[[ord(c) for c in "etaoinsrhdl"]], w[32] = 12.0, 36.0
    return w


_static: dict[int, tuple] = {}
#: Payloads from this size on have prefix codes of their own and a colour cache; smaller ones share one set.
OWN_CODES, CACHE_BITS = 8192, 7


def _static_codes() -> tuple:
    if not _static:
        green = np.concatenate([_text_weights(), np.full(24, 0.3)])
        lens = [code_lengths(green), *([code_lengths(_text_weights())] * 3), code_lengths(np.eye(1, 40, 1)[0])]
        w = BitWriter()
        for x in lens:
            _write_code(w, x)
        _static[0] = (lens, [_reversed_codes(x) for x in lens], w.value, w.n)
    return _static[0]


def _hashes(argb: np.ndarray, bits: int) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(_MUL)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def _runs(argb: np.ndarray, least: int = 4) -> list[tuple[int, int]]:
    """(start, length) of repetitions of the pixel before."""
    same = np.zeros(len(argb) + 1, dtype=bool)
    same[1:-1] = argb[1:] == argb[:-1]
    if not same.any():
        return []
    edge = np.diff(same.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    return [(a, min(4096, b - x)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= least for x in [a]]


def encode_stream(argb: np.ndarray, own: bool, cache_bits: int = 0) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Head value and bits (cache flag to prefix codes), then codes and lengths of all tokens in order."""
    n = len(argb)
    kinds, values = np.zeros(n, dtype=np.int8), argb.astype(np.int64)
    covered = np.zeros(n, dtype=bool)
    runs = _runs(argb)
    for a, k in runs:
        kinds[a] = COPY
        covered[a + 1 : a + k] = True
    keep = ~covered
    if cache_bits:
        h = _hashes(argb, cache_bits).astype(np.int64)
        order = np.argsort(h, kind="stable")
        hit = np.zeros(n, dtype=bool)
        hit[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        hit &= kinds == LITERAL
        kinds[hit], values[hit] = CACHED, h[hit]
    tokens = np.flatnonzero(keep)
    kind = kinds[tokens]
    lit = kind == LITERAL
    size = 280 + (1 << cache_bits if cache_bits else 0)
    green = np.where(lit, values[tokens] >> 8 & 255, 280 + np.where(kind == CACHED, values[tokens], 0))
    copies = [_value_prefix(k) for _, k in runs]
    green[kind == COPY] = [256 + c[0] for c in copies]
    v = values[tokens]
    channels = [green, v >> 16 & 255, v & 255, v >> 24 & 255]
    if own:
        lens = [code_lengths(np.bincount(channels[0], minlength=size))]
        lens += [code_lengths(np.bincount(c[lit], minlength=256)) for c in channels[1:]]
        lens.append(code_lengths(np.eye(1, 40, 1)[0]))
        codes = [_reversed_codes(x) for x in lens]
        w = BitWriter()
        w.write(1 if cache_bits else 0, 1)
        if cache_bits:
            w.write(cache_bits, 4)
        w.write(0, 1)
        for x in lens:
            _write_code(w, x)
        head, head_bits = w.value, w.n
        lens = [x if len(np.flatnonzero(x)) > 1 else np.zeros_like(x) for x in lens]
    else:
        lens, codes, head, head_bits = _static_codes()
        head, head_bits = head << 2, head_bits + 2
        lens = [*lens[:4], np.zeros(40, dtype=np.int64)]
    code, bits = codes[0][green].astype(np.uint64), lens[0][green]
    if not lens[0].any():
        code = np.zeros_like(code)
    for c, cl, ch in zip(codes[1:4], lens[1:4], channels[1:], strict=True):
        part = np.where(lit & (cl[ch] > 0), c[ch], 0).astype(np.uint64)
        code |= part << bits.astype(np.uint64)
        bits = bits + np.where(lit, cl[ch], 0)
    if copies:
        at = np.flatnonzero(kind == COPY)
        extra, more = np.array([c[1] for c in copies], dtype=np.uint64), np.array([c[2] for c in copies])
        code[at] |= extra << bits[at].astype(np.uint64)
        bits[at] += more
    return head, head_bits, code, bits


def pack_bits(head: int, head_bits: int, code: np.ndarray, bits: np.ndarray) -> bytes:
    """Little-endian bits of the head and then of all codes (each under 57 bits)."""
    total = head_bits + int(bits.sum())
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    raw = head.to_bytes(8 * ((head_bits >> 6) + 1), "little")
    words[: len(raw) // 8] = np.frombuffer(raw, dtype="<u8")
    pos = head_bits + np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(np.int64)
    off = (pos & 63).astype(np.uint64)
    np.bitwise_or.at(words, pos >> 6, code << off)
    np.bitwise_or.at(words, (pos >> 6) + 1, np.where(off > 0, code >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0)))
    return words.tobytes()[: (total + 7) >> 3]


def _container(bits: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(bits)) + bits + b"\0" * (len(bits) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def _image_head(width: int, height: int) -> tuple[int, int]:
    return 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40


def encode(argb: np.ndarray, width: int) -> bytes:
    """Pixels (uint32, row by row) as a WebP file. Up to 16 colours become a palette with bundled indices."""
    height = len(argb) // width
    head, n = _image_head(width, height)
    colours = np.unique(argb[:4096]) if len(argb) else argb
    if len(colours) <= 16 and len(colours := np.unique(argb)) <= 16:
        head |= 1 << n | PALETTE << (n + 1) | (len(colours) - 1) << (n + 3)
        n += 11
        table = np.concatenate([colours[:1], _channel(colours[1:], colours[:-1], -1)])
        # The table is an image without a flag for prefix-code groups.
        h2, n2, c2, b2 = encode_stream(table, True)
        h2 = (h2 & 1) | (h2 >> 2 << 1)
        n2 -= 1
        raw = int.from_bytes(pack_bits(h2, n2, c2, b2), "little")
        head |= raw << n
        n += n2 + int(b2.sum())
        index = np.searchsorted(colours, argb)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        per, depth = 1 << bits, 8 >> bits
        rows = index.reshape(height, width)
        rows = np.pad(rows, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        argb = ((rows << (depth * np.arange(per))).sum(axis=2) << 8 | 0xFF000000).astype(np.uint32).ravel()
        own, cache = True, 0
    else:
        own = 4 * len(argb) >= OWN_CODES
        cache = CACHE_BITS if own else 0
    h, k, code, bits = encode_stream(argb, own, cache)
    # After the transforms: no more of them, then the stream's head.
    return _container(pack_bits(head | h << (n + 1), n + 1 + k, code, bits))


def _channel(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """Channel-wise sum or difference modulo 256."""
    x, y = (np.ascontiguousarray(v, dtype="<u4").view(np.uint8) for v in (a, b))
    return (x + y if sign > 0 else x - y).view("<u4")


# ---- decoder ------------------------------------------------------------------------------------


class _Image:
    """One image's stream, read up to its first token."""

    __slots__ = ("cache_bits", "data", "groups", "height", "meta", "meta_bits", "pos", "transforms", "width", "xsize")


def _parse(data: bytes, reuse: dict) -> _Image:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    body = data[20 : 20 + struct.unpack_from("<I", data, 16)[0]]
    if body[:1] != b"\x2f":
        raise ValueError("bad signature")
    r, im = BitReader(body, 8), _Image()
    im.width, im.height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    im.data, im.transforms, im.xsize = body, [], im.width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            im.transforms.append((kind, bits, im.xsize, _sub_image(r, -(-im.xsize >> bits), -(-im.height >> bits))))
        elif kind == PALETTE:
            size = r.read(8) + 1
            deltas = np.ascontiguousarray(_sub_image(r, size, 1), dtype="<u4").view(np.uint8).reshape(-1, 4)
            table = np.cumsum(deltas, axis=0, dtype=np.uint8).view("<u4").ravel()
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            im.transforms.append((kind, bits, im.xsize, table))
            im.xsize = -(-im.xsize >> bits)
        else:
            im.transforms.append((kind, 0, im.xsize, None))
    im.cache_bits = r.read(4) if r.read(1) else 0
    im.meta = None
    groups = 1
    if r.read(1):
        im.meta_bits = r.read(3) + 2
        meta = _sub_image(r, -(-im.xsize >> im.meta_bits), -(-im.height >> im.meta_bits))
        im.meta = (meta >> 8 & 0xFFFF).astype(np.int64)
        groups = int(im.meta.max()) + 1
    im.groups = [_read_group(r, im.cache_bits, reuse) for _ in range(groups)]
    im.pos = r.pos
    return im


def _read_group(r: BitReader, cache_bits: int, reuse: dict | None = None) -> list[PrefixCode]:
    """Five codes. Streams that share codes share their tables: ``reuse`` maps the codes' own bits to them."""
    start = r.pos
    if reuse is not None:
        for (n, value), codes in reuse.items():
            at, shift = start >> 3, start & 7
            if cache_bits == 0 and (int.from_bytes(r.data[at : at + (n + shift + 7 >> 3)], "little") >> shift) & ((1 << n) - 1) == value:
                r.pos += n
                return codes
    codes = [_read_code(r, s) for s in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    if reuse is not None and cache_bits == 0 and len(reuse) < 4:
        n, at, shift = r.pos - start, start >> 3, start & 7
        value = (int.from_bytes(r.data[at : at + (n + shift + 7 >> 3)], "little") >> shift) & ((1 << n) - 1)
        reuse[n, value] = codes
    return codes


def _extra(r: BitReader, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + r.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _sub_image(r: BitReader, width: int, height: int) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    return _tokens_one(r, [_read_group(r, cache_bits)], None, 0, cache_bits, width, height)


def _tokens_one(r, groups, meta, meta_bits, cache_bits, width, height) -> np.ndarray:
    """Pixels of one stream, symbol by symbol."""
    total, at = width * height, 0
    kinds, values, lengths, distances = [], [], [], []
    across = -(-width >> meta_bits) if meta is not None else 0
    while at < total:
        g = groups[int(meta[(at // width >> meta_bits) * across + (at % width >> meta_bits)])] if meta is not None else groups[0]
        s = g[0].read(r)
        length = 1
        if s < 256:
            red, blue, alpha = (g[i].read(r) for i in (1, 2, 3))
            kinds.append(LITERAL)
            values.append(alpha << 24 | red << 16 | s << 8 | blue)
            distances.append(0)
        elif s < 280:
            length = _extra(r, s - 256)
            kinds.append(COPY)
            values.append(0)
            distances.append(_distance(_extra(r, g[4].read(r)), width))
        else:
            kinds.append(CACHED)
            values.append(s - 280)
            distances.append(0)
        lengths.append(length)
        at += length
    return resolve(np.array(kinds), np.array(values, dtype=np.int64), np.array(lengths), np.array(distances), cache_bits, total)


def resolve(kinds, values, lengths, distances, cache_bits: int, total: int) -> np.ndarray:
    """Tokens to pixels. Every pixel points at the one it repeats; doubling the pointers ends at literals."""
    if not (kinds != LITERAL).any():
        return values[:total].astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    token = np.repeat(np.arange(len(kinds)), lengths)[:total]
    place = np.arange(total)
    kind = kinds[token]
    up = np.where(kind == COPY, place - distances[token], place)
    if (up < 0).any():
        raise ValueError("back-reference before the first pixel")
    root = _double(up)
    if cache_bits:
        own = np.where(kinds[token[root]] == LITERAL, _hashes(values[token[root]].astype(np.uint32), cache_bits).astype(np.int64), values[token[root]])
        order = np.argsort(own, kind="stable")
        before = np.full(total, -1, dtype=np.int64)
        before[order[1:]] = np.where(own[order[1:]] == own[order[:-1]], order[:-1], -1)
        cached = kind == CACHED
        root = _double(np.where(cached, np.where(before >= 0, before, place), up))
        out = np.where(kind[root] == LITERAL, values[token[root]], 0)
    else:
        out = values[token[root]]
    del start
    return out.astype(np.uint32)


def _double(up: np.ndarray) -> np.ndarray:
    while True:
        nxt = up[up]
        if np.array_equal(nxt, up):
            return up
        up = nxt


def decode_many(files: list[bytes], lanes: int = 4096) -> list[tuple[np.ndarray, int, int]]:
    """(argb uint32, width, height) per file."""
    reuse: dict = {}
    images = [_parse(f, reuse) for f in files]
    pixels: list[np.ndarray | None] = [None] * len(images)
    order = sorted((i for i, im in enumerate(images) if im.meta is None), key=lambda i: -images[i].xsize * images[i].height)
    for at in range(0, len(order), lanes):
        part = order[at : at + lanes]
        for i, px in zip(part, _lockstep([images[i] for i in part]), strict=True):
            pixels[i] = px
    for i, im in enumerate(images):
        if im.meta is not None:
            pixels[i] = _tokens_one(BitReader(im.data, im.pos), im.groups, im.meta, im.meta_bits, im.cache_bits, im.xsize, im.height)
    return [(_invert(im, px), im.width, im.height) for im, px in zip(images, pixels, strict=True)]


def _lockstep(images: list[_Image]) -> list[np.ndarray]:
    """One lane per image, sorted by falling size. A step decodes one token of every lane still open."""
    tables, where, parts, size = {}, np.zeros((len(images), 5), dtype=np.int64), [], 0
    masks = np.zeros((len(images), 5), dtype=np.uint64)
    for i, im in enumerate(images):
        for j, code in enumerate(im.groups[0]):
            if id(code) not in tables:
                tables[id(code)] = size
                parts.append(code.table)
                size += len(code.table)
            where[i, j], masks[i, j] = tables[id(code)], (1 << code.width) - 1
    table = np.concatenate(parts)
    data = b"".join([im.data + b"\0" * 16 for im in images])
    offsets = np.concatenate([[0], np.cumsum([len(im.data) + 16 for im in images])[:-1]]).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    window = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(len(raw) - 7,), strides=(1,))
    pos = offsets * 8 + np.array([im.pos for im in images], dtype=np.int64)
    total = np.array([im.xsize * im.height for im in images], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64)
    n = int(total.sum())
    values = np.zeros(n, dtype=np.uint32)
    special: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    done, at = np.zeros(len(images), dtype=np.int64), base.copy()
    live = np.arange(len(images))
    seven = np.int64(7)

    def fetch(p):
        return window[p >> 3] >> (p & seven).astype(np.uint64)

    def symbol(lane, j, w):
        return table[where[lane, j] + (w & masks[lane, j]).astype(np.int64)]

    while len(live):
        p = pos[live]
        w = fetch(p)
        g = symbol(live, 0, w)
        p = p + (g & 15)
        s = g >> 4
        lit = s < 256
        if lit.all():
            k, gs, q = live, s, p
        else:
            k, gs, q = live[lit], s[lit], p[lit]
        r = symbol(k, 1, fetch(q))
        q = q + (r & 15)
        w = fetch(q)
        b = symbol(k, 2, w)
        nb = b & 15
        a = symbol(k, 3, w >> nb.astype(np.uint64))
        pos[k] = q + nb + (a & 15)
        values[at[k]] = (a >> 4) << 24 | (r >> 4) << 16 | gs << 8 | b >> 4
        at[k] += 1
        done[k] += 1
        if len(k) < len(live):
            rest = ~lit
            k, gs, q = live[rest], s[rest] - 256, p[rest]
            copy = gs < 24
            length, distance = np.ones(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
            c, ck = q[copy], k[copy]
            if len(ck):
                length[copy], c = _extras(gs[copy], c, fetch)
                d = symbol(ck, 4, fetch(c))
                distance[copy], c = _extras(d >> 4, c + (d & 15), fetch)
                q[copy] = c
            pos[k] = q
            special.append((k, at[k] - base[k], np.where(copy, COPY, CACHED), np.where(copy, length, gs - 24), distance))
            at[k] += 1
            done[k] += length
        over = done[live] >= total[live]
        if over.any():
            live = live[~over]
    out = []
    lane, token, kind, first, second = (np.concatenate(x) for x in zip(*special, strict=True)) if special else (np.zeros(0, dtype=np.int64),) * 5
    by = np.argsort(lane, kind="stable")
    bounds = np.searchsorted(lane[by], np.arange(len(images) + 1))
    for i, im in enumerate(images):
        own = by[bounds[i] : bounds[i + 1]]
        m = int(at[i] - base[i])
        v = values[base[i] : base[i] + m].astype(np.int64)
        if len(own) == 0:
            out.append(v.astype(np.uint32))
            continue
        kinds, lengths, distances = np.zeros(m, dtype=np.int64), np.ones(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        t = token[own]
        kinds[t] = kind[own]
        copies = own[kind[own] == COPY]
        lengths[token[copies]] = first[copies]
        distances[token[copies]] = [_distance(int(d), im.xsize) for d in second[copies]]
        hits = own[kind[own] == CACHED]
        v[token[hits]] = first[hits]
        out.append(resolve(kinds, v, lengths, distances, im.cache_bits, int(total[i])))
    return out


def _extras(s: np.ndarray, pos: np.ndarray, fetch) -> tuple[np.ndarray, np.ndarray]:
    n = np.where(s < 4, 0, (s - 2) >> 1)
    more = (fetch(pos) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << n) + more + 1), pos + n


# ---- inverse transforms -------------------------------------------------------------------------


def _invert(im: _Image, px: np.ndarray) -> np.ndarray:
    for kind, bits, xsize, data in reversed(im.transforms):
        if kind == SUBTRACT_GREEN:
            c = np.ascontiguousarray(px, dtype="<u4").view(np.uint8).reshape(-1, 4).copy()
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
            px = c.view("<u4").ravel()
        elif kind == CROSS_COLOUR:
            px = _add_colour(px, bits, xsize, im.height, data)
        elif kind == PREDICTOR:
            px = _add_prediction(px, bits, xsize, im.height, data)
        else:
            depth, per = 8 >> bits, 1 << bits
            packed = (px >> 8 & 255).astype(np.int64).reshape(im.height, -1)
            index = (packed[:, :, None] >> (depth * np.arange(per)) & ((1 << depth) - 1)).reshape(im.height, -1)[:, :xsize].ravel()
            table = np.concatenate([data, np.zeros(max(0, 256 - len(data)), dtype=np.uint32)])
            px = table[index]
    return px.astype(np.uint32)


def _spread(data: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """The block image's value of every pixel."""
    across = -(-width >> bits)
    rows = data.reshape(-1, across)[np.arange(height) >> bits]
    return rows[:, np.arange(width) >> bits].ravel()


def colour_deltas(element: np.ndarray, green: np.ndarray, red: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the cross-colour elements add to red and, given final red, to blue."""
    def signed(v):
        return v.astype(np.uint8).view(np.int8).astype(np.int64)

    g = signed(green & 255)
    add_red = signed(element & 255) * g >> 5
    new_red = (red + add_red) & 255
    add_blue = (signed(element >> 8 & 255) * g >> 5) + (signed(element >> 16 & 255) * signed(new_red) >> 5)
    return add_red, add_blue


def _add_colour(px, bits, width, height, data):
    e, v = _spread(data, bits, width, height).astype(np.int64), px.astype(np.int64)
    add_red, add_blue = colour_deltas(e, v >> 8, v >> 16 & 255)
    red, blue = (v >> 16 & 255) + add_red & 255, (v & 255) + add_blue & 255
    return (v & 0xFF00FF00 | red << 16 | blue).astype(np.uint32)


def predict(mode: int, left, top, top_left, top_right) -> list[int]:
    """Prediction per channel from four neighbours, each a sequence of channels."""
    def mean(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clamp(v):
        return min(255, max(0, v))

    if mode == 0:
        return [0, 0, 0, 255]
    if mode in (1, 2, 3, 4):
        return list((left, top, top_right, top_left)[mode - 1])
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return list(left if to_left < to_top else top)
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    half = mean(left, top)
    return [clamp(h + int((h - c) / 2)) for h, c in zip(half, top_left, strict=True)]


def _add_prediction(px, bits, width, height, data):
    """Residuals plus predictions, in raster order; channels blue, green, red, alpha."""
    modes = (_spread(data, bits, width, height) >> 8 & 15).tolist()
    flat = np.ascontiguousarray(px, dtype="<u4").view(np.uint8).reshape(-1, 4).tolist()
    for i, c in enumerate(flat):
        x, y = i % width, i // width
        if i == 0:
            p = [0, 0, 0, 255]
        elif y == 0:
            p = flat[i - 1]
        elif x == 0:
            p = flat[i - width]
        else:
            # The right-most pixel's upper right neighbour is the first of its own row.
            p = predict(modes[i], flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        flat[i] = [(a + b) & 255 for a, b in zip(c, p, strict=True)]
    return np.array(flat, dtype=np.uint8).reshape(-1).view("<u4")
