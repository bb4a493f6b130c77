"""Trains the block labeller on generated pages whose labels are known by construction.

Run ``python -m lodestack.llm.html_train`` to write html_weights.npz anew. Pages vary in layout, in how
their parts are marked (by tag, by class, by id or not at all), in order, in length and in faults.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from lodestack.llm.html import DIMS, HIDDEN, blocks, vectors

#: Names that pages give to their parts; fixed values.
ARTICLE = "article content post entry story main body text post-content entry-content article-body page-content prose".split()
MENU = "nav menu navbar navigation topnav breadcrumb breadcrumbs links site-nav main-menu tabs".split()
HEADER = "header masthead banner site-header top logo branding".split()
FOOTER = "footer site-footer copyright bottom legal colophon footer-links".split()
SIDEBAR = "sidebar side aside widget widgets related recommended trending popular rail more-stories".split()
NOTICE = "cookie cookies cookie-banner notice consent gdpr alert newsletter subscribe popup modal paywall".split()
ADVERT = "ad ads advert advertisement sponsored promo sponsor ad-slot banner-ad promoted".split()
FORM = "form search search-form login signup contact".split()
COMMENTS = "comments comment comment-list responses discussion reader-comments disqus replies thread".split()
SHARE = "share social social-links tags author-box pagination pager".split()


def _words(r: random.Random, n: int) -> list[str]:
    letters = "etaoinshrdluécßñü"
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 11))) for _ in range(n)]


def _sentence(r: random.Random, n: int) -> str:
    w = _words(r, max(1, n))
    if r.random() < 0.1:
        w = [x for y in w for x in (y, "|")]
    return " ".join(w).capitalize() + ("." if r.random() < 0.8 else "")


def _open(r: random.Random, tag: str, names: list[str]) -> str:
    name = r.choice(names)
    kind = r.random()
    if kind < 0.55:
        return f'<{tag} class="{name}">'
    if kind < 0.8:
        return f'<{tag} id="{name}">'
    return f'<{tag} class="{r.choice(["c", "box", "col", "row", "wrap"])} {name}">'


class _Page:
    """Markup in pieces; text of an article is wrapped in markers that tell its label."""

    def __init__(self, r: random.Random):
        self.r, self.parts, self.labels = r, [], []

    def text(self, tag: str, n: int, label: int, link: float = 0.0) -> None:
        r = self.r
        s = _sentence(r, n)
        if r.random() < link:
            s = f'<a href="/{r.random():.3f}">{s}</a>'
        elif r.random() < 0.1:
            s = f"<b>{s}" + ("</b>" if r.random() < 0.5 else "<br>")
        close = f"</{tag}>" if tag not in {"p", "li"} or r.random() < 0.85 else ""
        self.parts.append(f"<{tag}>{s}{close}")
        self.labels.append(label)

    def menu(self, names: list[str], tags: list[str]) -> None:
        r = self.r
        tag = r.choice(tags)
        head = f"<{tag}>" if tag in {"nav", "footer", "header", "aside"} and r.random() < 0.6 else _open(r, tag, names)
        self.parts.append(head + "<ul>")
        for _ in range(r.randint(1, 12)):
            self.text("li", r.randint(1, 4), 0, 0.95)
        self.parts.append(f"</ul></{tag}>")

    def part(self, names: list[str], tags: list[str], longest: int, link: float, paragraphs: int = 2) -> None:
        r = self.r
        tag = r.choice(tags)
        own = tag in {"nav", "footer", "header", "aside", "form"}
        self.parts.append(f"<{tag}>" if own and r.random() < 0.6 else _open(r, tag, names))
        for i in range(r.randint(1, paragraphs)):
            inner = r.choice(["p", "div", "h3", "span", "li"]) if i or r.random() < 0.5 else None
            if inner == "span" or inner is None:
                self.parts.append(f"{_sentence(r, r.randint(2, longest))}<!-- {r.random()} -->")
                if not self.parts or len(self.parts) < 2 or not self.parts[-2].endswith("<!--c-->"):
                    self.labels.append(0)
                self.parts.append("<hr>")
            else:
                self.text(inner, r.randint(2, longest), 0, link)
        self.parts.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        kind = r.random()
        if kind < 0.45:
            head, tail = "<article>", "</article>"
        elif kind < 0.6:
            head, tail = "<main>", "</main>"
        elif kind < 0.9:
            head, tail = _open(r, r.choice(["div", "section"]), ARTICLE), "</div>"
            tail = "</section>" if head.startswith("<section") else tail
        else:
            head, tail = "<div>", "</div>"
        self.parts.append(head)
        if r.random() < 0.8:
            self.text(r.choice(["h1", "h1", "h2"]), r.randint(2, 14), 1)
        few = r.random() < 0.2
        for _ in range(1 if few else r.randint(1, 14)):
            if r.random() < 0.08:
                self.part(r.choice([ADVERT, SHARE, SIDEBAR, NOTICE]), ["div", "aside"], 20, 0.3, 1)
            tag = r.choice(["p"] * 9 + ["h2", "h3", "li", "blockquote", "div", "pre"])
            self.text(tag, r.choice([1, 3, 8, 20, 50, 90]), 1, 0.04)
        self.parts.append(tail)


def generated_page(seed: int) -> tuple[str, list[int]]:
    """(html, label of each leaf block)."""
    r = random.Random(seed)
    p = _Page(r)
    p.parts.append(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{_sentence(r, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";track({seed});</script></head><body>')
    for make in r.sample([lambda: p.part(HEADER, ["header", "div"], 8, 0.5), lambda: p.menu(MENU, ["nav", "div"]), lambda: p.part(ADVERT, ["div", "aside", "section"], 25, 0.3), lambda: p.part(NOTICE, ["div", "section"], 30, 0.2), lambda: p.part(FORM, ["form", "form", "div"], 8, 0.1), lambda: p.part(SIDEBAR, ["aside", "div"], 20, 0.6)], r.randint(0, 4)):
        make()
    if r.random() < 0.97:
        p.article()
    for make in [lambda: p.part(SHARE, ["div"], 8, 0.7), lambda: p.part(COMMENTS, ["div", "section", "ol"], 40, 0.1, 6), lambda: p.part(SIDEBAR, ["aside", "div"], 25, 0.6), lambda: p.part(ADVERT, ["div"], 25, 0.3), lambda: p.part(NOTICE, ["div"], 25, 0.2), lambda: p.part(FORM, ["form"], 8, 0.1), lambda: p.menu(MENU, ["nav", "div"])]:
        if r.random() < 0.25:
            make()
    if r.random() < 0.8:
        p.part(FOOTER, ["footer", "footer", "div"], 20, 0.3)
    page = "".join(p.parts) + ("</body></html>" if r.random() < 0.9 else "")
    return page, p.labels


def examples(n: int, first: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pages whose blocks and labels agree in number; the few where markup faults merge blocks are left out."""
    out = []
    for seed in range(first, first + n):
        page, labels = generated_page(seed)
        cut = blocks(page)
        if len(cut) == len(labels) and cut:
            out.append((vectors(cut), np.array(labels, dtype=np.float32)))
    return out


def _direction(x, w, way):
    """Forward pass of one page batch (equal lengths): x (T, B, D) -> hidden (T, B, H) and what backward needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    kept, hidden = [], np.zeros((steps, batch, HIDDEN))
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = x[t] @ w[f"{way}x"] + w[f"{way}b"] + h @ w[f"{way}h"]
        g = 1.0 / (1.0 + np.exp(-z[:, : 3 * HIDDEN]))
        a = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        c2 = f * c + i * a
        tc = np.tanh(c2)
        kept.append((t, h, c, i, f, o, a, tc))
        h, c = o * tc, c2
        hidden[t] = h
    return hidden, kept


def _gradient(x, w, way, kept, dh_all, grads):
    dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
    for t, h, c, i, f, o, a, tc in reversed(kept):
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
        grads[f"{way}x"] += x[t].T @ dz
        grads[f"{way}h"] += h.T @ dz
        grads[f"{way}b"] += dz.sum(0)
        dh, dc = dz @ w[f"{way}h"].T, dc * f


def train(pages: int = 6000, epochs: int = 6, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for way in "fr":
        w[f"{way}x"] = rng.normal(0, 0.1, (DIMS, 4 * HIDDEN))
        w[f"{way}h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        w[f"{way}b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"], w["ob"] = rng.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    data = examples(pages)
    by_length: dict[int, list[int]] = {}
    for i, (x, _) in enumerate(data):
        by_length.setdefault(len(x), []).append(i)
    step = 0
    for epoch in range(epochs):
        batches = []
        for group in by_length.values():
            order = rng.permutation(group)
            batches += [order[k : k + 32] for k in range(0, len(order), 32)]
        rng.shuffle(batches)
        loss = n = 0.0
        for batch in batches:
            x = np.stack([data[i][0] for i in batch], axis=1).astype(np.float64)
            y = np.stack([data[i][1] for i in batch], axis=1)[..., None]
            f, kf = _direction(x, w, "f")
            b, kb = _direction(x, w, "r")
            both = np.concatenate([f, b], axis=2)
            p = 1.0 / (1.0 + np.exp(-(both @ w["o"] + w["ob"])))
            loss -= float((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).sum())
            n += y.size
            d = (p - y) / y.size
            grads = {k: np.zeros_like(z) for k, z in w.items()}
            grads["o"] = np.tensordot(both, d, axes=([0, 1], [0, 1]))
            grads["ob"] = d.sum((0, 1))
            dboth = d @ w["o"].T
            _gradient(x, w, "f", kf, dboth[..., :HIDDEN], grads)
            _gradient(x, w, "r", kb, dboth[..., HIDDEN:], grads)
            step += 1
            rate = 0.01 * (0.5**epoch)
            for k in w:
                g = np.clip(grads[k], -1, 1) + 1e-6 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / n:.4f}", flush=True)
    return {k: x.astype(np.float32) for k, x in w.items()}


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **train())
