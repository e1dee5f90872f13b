"""HTML extraction by a recurrent block labeller.

Each leaf block of a page is a vector: the sum of embeddings of its tag path (tags, the words
of class, id and role, and its last two steps), the mean of its hashed-word vectors, and a few figures. A
bidirectional LSTM in numpy reads the blocks of the whole page in order and labels each as
main text or not. It is trained here, by back-propagation through time, on pages made from
random layouts whose labels are known; their number is ``TRAIN_PAGES``. No row of a page
table is needed for training, so every page is treated alike.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import column_of, tune
from opalgrid.llm.html_blocks import PATHS, WORDS, Block, Page, _bucket, blocks_of

TRAIN_PAGES, STEPS, SEED = 1500, 300, 11
HIDDEN, PATH_DIM, WORD_DIM, FIGURES = 16, 24, 8, 7
INPUT = PATH_DIM + WORD_DIM + FIGURES

# Names that layouts of web pages give to their parts.
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs links toc pagination pager",
    "header": "header masthead top branding logo site-header page-header banner hero-bar",
    "footer": "footer site-footer bottom copyright legal colophon page-footer foot",
    "side": "sidebar aside side widget related rail recommended more-stories trending tags share social author-box",
    "ad": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad adslot",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall disclaimer privacy",
    "comments": "comments comment comment-list replies reply discussion disqus reader-comments responses",
    "main": "content main post entry story article body text page-content post-body entry-content article-body",
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "section", "ins"], "notice": ["div", "section", "aside"], "comments": ["section", "div", "ol"]}
_SAID = {
    "nav": "home about contact news sport login menu archive search help blog shop",
    "footer": "© copyright all rights reserved terms privacy imprint contact 2020 2021",
    "ad": "advertisement sponsored buy now sale offer free",
    "notice": "we use cookies accept this site consent privacy subscribe to our newsletter",
    "comments": "reply said thanks agree posted ago comment likes",
    "side": "related most read share follow popular tags",
    "header": "welcome daily news site",
}


class _Maker:
    """Random pages with a label for each block (``data-main`` would be cheating: texts are marked)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(map(self.r.choice, ("bcdfghlmnprstvw", "aeiouéü", "nrstlm "))).strip() for _ in range(90)]
        self.k = 0

    def pick(self, options: list[str]) -> str:
        return options[int(self.r.random() * len(options))]

    def words(self, low: int, high: int, said: str = "") -> str:
        known = said.split()
        out = []
        for _ in range(self.r.randrange(low, high)):
            out.append(self.pick(known) if known and self.r.random() < 0.3 else "".join(self.pick(self.syllables) for _ in range(self.r.randrange(1, 4))))
            if self.r.random() < 0.15:
                out[-1] += self.pick([".", ",", "."])
        text = " ".join(out)
        return (text[:1].upper() + text[1:]) + ("." if self.r.random() < 0.5 else "")

    def said(self, main: bool, low: int, high: int, said: str = "") -> str:
        """A text whose first character tells its label: a private-use mark, removed after parsing.
        Lengths are spread evenly over their logarithms: short paragraphs are as usual as long ones."""
        if high > 30:
            high = low + 1 + int(np.exp(self.r.uniform(0, np.log(high))))
        return ("\ue001" if main else "\ue000") + self.words(low, high, said)

    def attrs(self, kind: str, p: float) -> str:
        if self.r.random() > p:
            return ""
        return f' {self.pick(["class", "class", "id"])}="{self.pick(NAMES[kind].split())}"'

    def links(self, kind: str) -> str:
        n = self.r.randrange(2, 8)
        item = self.pick(["<li><a href='/x'>{}</a></li>", "<li><a href='/x'>{}</a>", "<div><a href='/x'>{}</a></div>"])
        inner = "".join(item.format(self.said(False, 1, 4, _SAID[kind])) for _ in range(n))
        return f"<ul>{inner}</ul>" if "<li>" in item else inner

    def part(self, kind: str) -> str:
        tag = self.pick(_TAGS[kind])
        attrs = self.attrs(kind, 0.4 if tag in ("nav", "header", "footer", "aside") else 1.0)
        shape = self.r.random()
        if kind == "nav" or shape < 0.2:
            inner = self.links(kind)
        elif kind == "comments":
            one = self.pick(["<li>{}</li>", "<div class='comment'>{}</div>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"])
            inner = f"<h3>{self.said(False, 1, 3, _SAID[kind])}</h3>" * (self.r.random() < 0.5) + "".join(one.format(self.said(False, 3, 40, _SAID[kind])) for _ in range(self.r.randrange(1, 5)))
        elif shape < 0.6:
            inner = self.said(False, 2, 25, _SAID[kind])
        else:
            inner = "".join(f"<p>{self.said(False, 2, 30, _SAID[kind])}</p>" for _ in range(self.r.randrange(1, 3)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def form(self) -> str:
        return f"<form action='/s'{self.attrs('notice', 0.3)}><label>{self.said(False, 1, 5)}</label><input name='q'><button>{self.said(False, 1, 3)}</button></form>"

    def body(self) -> str:
        out = []
        if self.r.random() < 0.05:  # a long text that says the same over and over
            tag, t, n = self.pick(["p", "p", "div", "li"]), self.said(True, 1, 12), self.r.randrange(8, 120)
            out.append("".join(f"<{tag}>{t}</{tag}>" for _ in range(n)))
        for _ in range(self.r.randrange(1, 9)):
            k = self.r.random()
            t = self.said(True, 1, 120)
            if k < 0.6:
                out.append(self.pick([f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<div>{t}</div>"]))
            elif k < 0.72:
                out.append(f"<{(h := self.pick(['h2', 'h2', 'h3', 'h4']))}>{self.said(True, 1, 9)}</{h}>")
            elif k < 0.8:
                out.append(f"<{(l := self.pick(['ul', 'ul', 'ol']))}>" + "".join(f"<li>{self.said(True, 1, 15)}</li>" for _ in range(self.r.randrange(1, 6))) + f"</{l}>")
            elif k < 0.86:
                out.append(self.pick([f"<blockquote><p>{t}</p></blockquote>", f"<blockquote>{t}</blockquote>"]))
            elif k < 0.9:
                out.append(f"<table><tr><td>{self.said(True, 1, 5)}</td><td>{self.said(True, 1, 5)}</td></tr></table>")
            elif k < 0.93:
                out.append(f"<pre>{t}</pre>")
            elif k < 0.955:
                out.append(f"<figure><img src='x'><figcaption>{self.said(True, 2, 12)}</figcaption></figure>")
            else:
                out.append(self.part(self.pick(["ad", "ad", "side", "side", "notice"])))
        return "".join(out)

    def page(self) -> str:
        head = f"<h1>{self.said(True, 1, 14)}</h1>"
        if self.r.random() < 0.15:
            head = f"<header>{head}</header>"
        wrap = self.pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div{a}>{}</div>", "<div{a}><article>{}</article></div>", "<section{a}>{}</section>"])
        inner = (head if self.r.random() < 0.9 else "") + self.body()
        late = ""
        if self.r.random() < 0.2:
            late = self.part("comments")
            if self.r.random() < 0.4:
                inner, late = inner + late, ""
        main = wrap.replace("{a}", self.attrs("main", 1.0)).replace("{}", inner)
        before = [self.part(k) for k in ("header", "nav", "ad", "notice", "side") if self.r.random() < 0.5]
        after = [self.part(k) for k in ("side", "nav", "ad", "notice", "footer") if self.r.random() < (0.8 if k == "footer" else 0.35)]
        if self.r.random() < 0.25:
            (before if self.r.random() < 0.5 else after).insert(0, self.form())
        end = "</body></html>" if self.r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{''.join(before)}{main}{late}{''.join(after)}{end}"


class WordBuckets(dict):
    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = _bucket(word.lower(), WORDS)
        return got


def figures(b: Block, n_words: int) -> tuple[float, ...]:
    n = len(b.text)
    marks = b.text.count(".") + b.text.count(",")
    return (np.log1p(n) / 5, np.log1p(n_words) / 3, b.linked, min(1.0, 5 * marks / max(1, n_words)), float(b.text[-1] in ".!?"), float(b.heading), min(2.0, b.depth / 8))


def _summed(table: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the table rows ``at``, the first n[0] of them, the next n[1] and so on."""
    total = np.zeros((len(n), table.shape[1]), np.float32)
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(table[at], (np.cumsum(n) - n)[some], axis=0)
    return total


def _spread(grad: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of ``values`` to the row ``at`` of ``grad``."""
    for k in range(grad.shape[1]):
        grad[:, k] += np.bincount(at, values[:, k], len(grad)).astype(np.float32)


class Encoded:
    """Pages as flat arrays: what each block says, and the elements that open and close around the
    blocks. A path is a running sum over those, so a page costs no more for being deep."""

    ARRAYS = ("sizes", "steps", "at", "word", "word_n", "figures", "event_sizes", "token", "token_n", "sign")

    def __init__(self, pages: list[Page], words: WordBuckets):
        word, word_n, rows, steps, at = [], [], [], [], []
        for page in pages:
            for b in page:
                found = [words[w] for w in b.text.split()]
                word.extend(found)
                word_n.append(len(found))
                rows.append(figures(b, len(found)))
                steps.append(b.steps)
                at.append(b.at)
        events = [e for p in pages for e in p.events]
        self.sizes, self.event_sizes = (np.array(x, np.int64) for x in ([len(p) for p in pages], [len(p.events) for p in pages]))
        self.steps, self.at = np.array(steps, np.int64).reshape(-1, 2), np.array(at, np.int64)
        self.word, self.word_n = np.array(word, np.int64), np.array(word_n, np.int64)
        self.figures = np.array(rows, np.float32).reshape(-1, FIGURES)
        self.token_n = np.array([len(e) for e in events], np.int64)
        self.token = np.fromiter((t for e in events for t in e), np.int64, int(self.token_n.sum()))
        self.sign = np.array([s for p in pages for s in p.signs], np.float32)

    @classmethod
    def joined(cls, parts: list[Encoded]) -> Encoded:
        out = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block how many events of all pages stand before its page, and before it."""
        base = np.repeat(np.cumsum(self.event_sizes) - self.event_sizes, self.sizes)
        return base, base + self.at

    def vectors(self, w: dict) -> np.ndarray:
        running = np.zeros((len(self.sign) + 1, PATH_DIM))
        np.cumsum(_summed(w["path"], self.token, self.token_n) * self.sign[:, None], axis=0, dtype=np.float64, out=running[1:])
        base, at = self.places()
        path = (running[at] - running[base]).astype(np.float32) + w["path"][self.steps].sum(axis=1)
        words = _summed(w["word"], self.word, self.word_n) / np.maximum(1, self.word_n)[:, None].astype(np.float32)
        return np.concatenate([path, words, self.figures], axis=1)

    def path_gradient(self, d: np.ndarray, grad: np.ndarray) -> None:
        """Adds to ``grad`` what the path parts ``d`` of the blocks give: an event counts for all blocks
        of its page that come after it."""
        running = np.zeros((len(d) + 1, PATH_DIM))
        np.cumsum(d, axis=0, dtype=np.float64, out=running[1:])
        last = np.repeat(np.cumsum(self.sizes), self.event_sizes)
        first = np.minimum(np.searchsorted(self.places()[1], np.arange(len(self.sign)), side="right"), last)
        own = (running[last] - running[first]) * self.sign[:, None]
        _spread(grad, self.token, np.repeat(own, self.token_n, axis=0))
        _spread(grad, self.steps.ravel(), np.repeat(d, 2, axis=0))


def padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each cell's block (pages x steps), the same from the end, and the mask."""
    first = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.max()) if len(sizes) else 0)
    mask = step[None] < sizes[:, None]
    ahead = np.where(mask, first[:, None] + step[None], 0)
    back = np.where(mask, first[:, None] + sizes[:, None] - 1 - step[None], 0)
    return ahead, back, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(x: np.ndarray, u: np.ndarray, learning: bool) -> tuple[np.ndarray, list]:
    """x: pages x steps x 4H, the inputs' share of the gates. States of all steps, and what backward
    needs (kept only when ``learning``)."""
    pages, steps, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, kept = np.empty((pages, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = x[:, t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[:, t] = h
        if learning:
            kept.append((i, f, o, g, th, *before))
    return out, kept


def lstm_back(d_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pages, steps, _ = d_out.shape
    dx, du = np.empty((pages, steps, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, th, h0, c0 = kept[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dx[:, t] = dz
        du += h0.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


def start_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"path": np.zeros((PATHS, PATH_DIM)), "word": np.zeros((WORDS, WORD_DIM)), "out": r.normal(0, 0.2, 2 * HIDDEN), "skip": np.zeros(INPUT), "bias": np.zeros(1)}
    for d in ("a", "b"):
        w[f"w{d}"] = r.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
        w[f"u{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.zeros(4 * HIDDEN)
        w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def forward(e: Encoded, w: dict, learning: bool = True) -> tuple[np.ndarray, tuple]:
    """Logit of each block, and the parts that backward needs."""
    x = e.vectors(w)
    ahead, back, mask = padded(e.sizes)
    ha, ka = lstm((x @ w["wa"] + w["ca"])[ahead], w["ua"], learning)
    hb, kb = lstm((x @ w["wb"] + w["cb"])[back], w["ub"], learning)
    fa, fb = np.empty((len(x), HIDDEN), np.float32), np.empty((len(x), HIDDEN), np.float32)
    fa[ahead[mask]], fb[back[mask]] = ha[mask], hb[mask]
    both = np.concatenate([fa, fb], axis=1)
    return both @ w["out"] + x @ w["skip"] + w["bias"][0], (x, ahead, back, mask, ka, kb, both)


def gradients(e: Encoded, w: dict, d: np.ndarray, parts: tuple) -> dict[str, np.ndarray]:
    x, ahead, back, mask, ka, kb, both = parts
    grad = {"out": both.T @ d, "skip": x.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_both = d[:, None] * w["out"][None]
    dx = d[:, None] * w["skip"][None]
    for name, at, kept, part in (("a", ahead, ka, d_both[:, :HIDDEN]), ("b", back, kb, d_both[:, HIDDEN:])):
        dz_steps, grad[f"u{name}"] = lstm_back(np.where(mask[..., None], part[at], 0).astype(np.float32), kept, w[f"u{name}"])
        dz = np.zeros((len(x), 4 * HIDDEN), np.float32)
        dz[at[mask]] = dz_steps[mask]
        grad[f"w{name}"], grad[f"c{name}"] = x.T @ dz, dz.sum(axis=0)
        dx += dz @ w[f"w{name}"].T
    grad["path"], grad["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
    e.path_gradient(dx[:, :PATH_DIM], grad["path"])
    _spread(grad["word"], e.word, np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(1, e.word_n)[:, None], e.word_n, axis=0))
    return grad


def training_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[Page, np.ndarray]]:
    maker, out = _Maker(seed), []
    for _ in range(n):
        blocks = blocks_of(maker.page())
        y = np.array([b.text[0] == "\ue001" for b in blocks], np.float32)
        plain = [b._replace(text=b.text.replace("\ue001", "").replace("\ue000", "") or ".") for b in blocks]
        out.append((Page(plain, blocks.events, blocks.signs), y))
    return [x for x in out if x[0]]


_trained: list[dict] = []


def trained() -> dict[str, np.ndarray]:
    """Weights; the same in every process, kept after the first call."""
    if _trained:
        return _trained[0]
    pages, r, w = training_pages(), np.random.default_rng(SEED), start_weights()
    words = WordBuckets()
    ready = [(Encoded([b], words), y) for b, y in pages]
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, STEPS + 1):
        batch = [ready[i] for i in r.integers(0, len(ready), 32)]
        e, y = Encoded.joined([b for b, _ in batch]), np.concatenate([y for _, y in batch])
        logit, parts = forward(e, w)
        g = gradients(e, w, ((_sigmoid(logit) - y) / len(y)).astype(np.float32), parts)
        rate = 0.03 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    _trained.append(w)
    return w


def label_pages(pages: list[Page], w: dict, words: WordBuckets, cells: int = 30_000) -> list[np.ndarray]:
    """Whether each block is main text. Pages of like length are read together, as many as ``cells``
    blocks (padding included) and ten times as many events hold; a larger page is read alone."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    at = 0
    while at < len(order):
        stop, events = at + 1, len(pages[order[at]].events)
        while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= cells and events + len(pages[order[stop]].events) <= 10 * cells:
            events += len(pages[order[stop]].events)
            stop += 1
        mine = order[at:stop]
        logit, _ = forward(Encoded([pages[i] for i in mine], words), w, learning=False)
        for i, part in zip(mine, np.split(logit, np.cumsum([len(pages[i]) for i in mine])[:-1]), strict=True):
            out[i] = part > 0
        at = stop
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with text (main text, blocks joined by a line break; empty if
    none) and n_chars (its code points). Columns of these names are replaced.

    A null or empty page gives an empty text; broken markup is read as far as it goes. Time and
    memory grow with the length of a page, however deep it nests. Rows that repeat give equal
    texts; an empty table gives an empty result.
    """
    tune(pages.sparkSession)
    w = trained()
    rows = pages.drop("text", "n_chars")
    kept = [f for f in rows.schema.fields if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordBuckets()
        for batch in batches:
            found = [blocks_of(h or "") for h in column_of(batch, html_col).to_pylist()]
            texts = ["\n".join(b.text for b, k in zip(p, keep.tolist(), strict=True) if k) for p, keep in zip(found, label_pages(found, w, words), strict=True)]
            arrays = [column_of(batch, f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.select(*[F.col(f.name) for f in kept], F.col(html_col)).mapInArrow(run, schema)
