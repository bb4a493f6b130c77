"""Token ids of whole texts, each distinct word encoded once per worker.

The public word-level vocabulary drops white space, so the ids of a text are those of its
space-separated words in order. Workers keep a bounded table of words already encoded; a word that
is not in it goes through the tokenizer.
"""

from __future__ import annotations

import os
import re

VOCABULARY = "word_bpe_49k.json"
#: Words and pieces of words kept by a worker before a table starts afresh. Only speed depends on them.
TABLE_WORDS, TABLE_PIECES = 400_000, 600_000

#: Words of these characters are cut into pieces without the tokenizer: ASCII and precomposed Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")



def _byte_letters() -> dict[int, str]:
    """Letters of byte-level vocabularies for the UTF-8 bytes of U+0080 to U+00FF: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


_BYTES = _byte_letters()
_encoders: dict[tuple[str, bool], WordEncoder] = {}


class WordEncoder:
    """Ids as little-endian unsigned 16-bit bytes (the vocabulary has under 65,536 entries)."""

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import numpy as np
        from tokenizers import pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        # Pieces are lower-case, composed and cut already: a space between two is all that has to be told apart.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self._forget()

    def _ids(self, items: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in found]

    def _piece_ids(self, pieces: list[str], at_once: int = 1000) -> list[bytes]:
        """As _ids, for pieces that each end in one token with the vocabulary's mark of an end."""
        import numpy as np

        groups = [pieces[i : i + at_once] for i in range(0, len(pieces), at_once)]
        out: list[bytes] = []
        for group, found in zip(groups, self.plain.encode_batch_fast([" ".join(g).translate(_BYTES) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u2")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                out += self._ids(group)
                continue
            raw, stops = ids.tobytes(), (2 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    def _learn(self, missing: list[bytes]) -> None:
        """Words of plain characters are cut into pieces all at once, a line end between two; pieces known already are looked up."""
        import numpy as np

        decoded = [w.decode("utf-8", "replace") for w in missing]
        plain = [bool(_PLAIN.fullmatch(s)) and "<|" not in s for s in decoded]
        odd = [i for i, p in enumerate(plain) if not p]
        if odd:
            self.words.update(zip([missing[i] for i in odd], self._ids([decoded[i] for i in odd]), strict=True))
            missing = [w for w, p in zip(missing, plain, strict=True) if p]
            decoded = [s for s, p in zip(decoded, plain, strict=True) if p]
        pieces = _PIECE.findall("\n".join([*decoded, ""]).lower())
        fresh = list(set(pieces).difference(self.pieces))
        if fresh:
            found = self._piece_ids(fresh)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
            begin = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), dtype="<u2")])
            self.pieces.update(zip(fresh, range(len(self.begin), len(self.begin) + len(fresh)), strict=True))
            self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
        places = np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        sizes = self.size[places]
        stops = np.cumsum(sizes)
        at = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.begin[places] - (stops - sizes), sizes)
        raw, ends = self.flat[at].tobytes(), (2 * stops[places == 0]).tolist()
        self.words.update(zip(missing, [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _forget(self) -> None:
        import numpy as np

        # Piece 0 is the line end between two words; it has no ids.
        self.pieces: dict[str, int] = {"\n": 0}
        self.flat, self.begin, self.size = np.zeros(0, dtype="<u2"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text; null is empty. Call it with bounded batches."""
        split = [(t or b"").split() for t in texts]
        get = self.words.get
        found = [list(map(get, ws)) for ws in split]
        holes = [[i for i, f in enumerate(fs) if f is None] for fs in found]
        missing = {ws[i] for ws, at in zip(split, holes, strict=True) for i in at}
        if missing:
            if len(self.words) + len(missing) > TABLE_WORDS:
                self.words = {}
                if len(self.pieces) > TABLE_PIECES:
                    self._forget()
            self._learn(list(missing))
            for ws, fs, at in zip(split, found, holes, strict=True):
                for i in at:
                    fs[i] = self.words[ws[i]]
        return list(map(b"".join, found))


def encoder(path: str | None = None, literal: bool = False) -> WordEncoder:
    """One per worker process. ``literal``: strings of special tokens in a text are ordinary text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if (path, literal) not in _encoders:
        _encoders[path, literal] = WordEncoder(path, literal)
    return _encoders[path, literal]


def slices(column, rows: int = 256, size: int = 4 << 20):
    """(start, list of bytes) of a binary Arrow column, each of bounded length."""
    start, held, n = 0, [], 0
    for i, v in enumerate(column):
        b = v.as_py()
        held.append(b)
        n += len(b or b"")
        if len(held) >= rows or n >= size:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held
