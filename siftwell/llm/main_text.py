"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks (``html_blocks``). Each is a vector: hashed names of the elements around it (tags,
parts of classes and ids, their first letters; those of the nearest elements once more), its hashed words, and a few
numbers. A bidirectional LSTM in numpy reads the sequence, so every block is judged with what stands before and behind it.

The labeller is trained here: on pages of ``block_layouts``, whose main text is known, filled with words of a bounded sample
of the corpus (``SAMPLE_PAGES`` pages, the least by a hash of their id and url; this is all that the fit sees). It learns
how parts of pages are called and built, not what any site looks like. Weights are some 100 kB, and so are what goes to tasks.

Extraction is one narrow stage. Whole pages are read; a page's memory is some fifty numbers a block. Null html is empty. A
page without blocks, or with none that is taken, has an empty text. Null ids and urls stay null; repeated rows give a result
each; an empty table gives an empty one (and a labeller of drawn words). Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.block_layouts import Page, drawn_pages
from siftwell.llm.common import Words
from siftwell.llm.html_blocks import Block, blocks

SAMPLE_PAGES = 64
SAMPLE_WORDS = 5_000
LAYOUTS, EPOCHS, BATCH, SEED = 1000, 7, 16, 11
NAMES, WORDS = 1024, 1024
NAME_DIM, WORD_DIM, NUMBERS, HIDDEN = 20, 6, 6, 20
DIM = NAME_DIM + WORD_DIM + NUMBERS
# Elements whose tag doesn't say what they are for.
PLAIN = frozenset("<html <body <div <section <p <h1 <h2 <h3 <h4 <h5 <h6 <ul <ol <li <dl <dt <dd <table <thead <tbody <tr <td <th <blockquote <figure <figcaption <pre <center".split())
# Pages that go through the recurrent layer together, and so many blocks at most (a longer page goes alone).
TOGETHER, TOGETHER_BLOCKS = 64, 1 << 14
# Letters of html whose blocks are held at once, whatever the size of a batch.
SLICE = 4_000_000


def _bucket(name: str, buckets: int = NAMES) -> int:
    return crc32(name.encode()) % buckets


def path_buckets(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Hashed names around a block: all of them, first letters of longer ones, and those of the two nearest elements and of
    the nearest that says what it is for."""
    names = {name for element in path for name in element}
    names |= {name[:4] + "-" for name in names if len(name) > 4 and name[0] != "<"}
    for near, element in enumerate(reversed(path[-2:])):
        names |= {f"{near}{name}" for name in element}
    telling = next((element for element in reversed(path) if any(name not in PLAIN for name in element)), ())
    names |= {f"in {part}" for name in telling if name not in PLAIN for part in (name, name[:4] + "-")}
    return np.unique([_bucket(name) for name in names]) if names else np.zeros(0, np.int64)


def word_buckets(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all blocks, one after another, and where each block's begin (blocks + 1 borders)."""
    texts = [block.text.lower().encode() for block in found]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    return (words.hashes % np.uint64(WORDS)).astype(np.int64), words.first


def numbers_of(found: list[Block], words: np.ndarray) -> np.ndarray:
    """Length, share of links, how it ends, and place in the page, for the blocks of one page."""
    n = len(found)
    out = np.zeros((n, NUMBERS), dtype=np.float32)
    out[:, 0] = np.log1p(words) / 4
    out[:, 1] = [block.linked / len(block.text) for block in found]
    out[:, 2] = [block.text[-1] in ".!?…" for block in found]
    out[:, 3] = (np.arange(n) + 0.5) / n
    out[:, 4] = [any(mark in block.text for mark in "©|·»") for block in found]
    out[:, 5] = words <= 3
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction(NamedTuple):
    """Weights of an LSTM that reads one way: input and state to the four gates, and state to the score."""

    inner: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    out: np.ndarray


class Labeller(NamedTuple):
    names: np.ndarray
    words: np.ndarray
    ahead: Direction
    back: Direction
    bias: np.ndarray

    def vectors(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The input vectors of each page's blocks."""
        found = [block for page in pages for block in page]
        if not found:
            return [np.zeros((0, DIM), np.float32) for _ in pages]
        buckets, first = word_buckets(found)
        counts = np.diff(first)
        sums = np.zeros((len(found), WORD_DIM), dtype=np.float32)
        filled = counts > 0
        sums[filled] = np.add.reduceat(self.words[buckets], first[:-1][filled], axis=0)
        known: dict[tuple, np.ndarray] = {}
        for block in found:
            if block.path not in known:
                known[block.path] = self.names[path_buckets(block.path)].sum(axis=0)
        x = np.empty((len(found), DIM), dtype=np.float32)
        x[:, :NAME_DIM] = [known[block.path] for block in found]
        x[:, NAME_DIM : NAME_DIM + WORD_DIM] = sums / np.maximum(counts, 1)[:, None]
        at = 0
        parts = []
        for page in pages:
            to = at + len(page)
            if page:
                x[at:to, NAME_DIM + WORD_DIM :] = numbers_of(page, counts[at:to])
            parts.append(x[at:to])
            at = to
        return parts

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the scores of its blocks; above 0 is main text."""
        vectors = self.vectors(pages)
        result: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group: list[int] = []
            while at < len(order) and len(group) < TOGETHER and (not group or (len(group) + 1) * len(pages[order[at]]) <= TOGETHER_BLOCKS):
                group.append(order[at])
                at += 1
            size = len(pages[group[-1]])
            x = np.zeros((size, len(group), DIM), dtype=np.float32)
            held = np.zeros((size, len(group), 1), dtype=np.float32)
            for column, i in enumerate(group):
                x[: len(pages[i]), column] = vectors[i]
                held[: len(pages[i]), column] = 1
            total = _read(x, held, self.ahead) + _read(x[::-1], held[::-1], self.back)[::-1] + self.bias
            for column, i in enumerate(group):
                result[i] = total[: len(pages[i]), column]
        return result


def _step(x: np.ndarray, h: np.ndarray, c: np.ndarray, d: Direction) -> tuple[np.ndarray, ...]:
    gates = x @ d.inner + h @ d.state + d.bias
    sig = _sigmoid(gates[:, : 3 * HIDDEN])
    i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
    g = np.tanh(gates[:, 3 * HIDDEN :])
    return i, f, o, g, f * c + i * g


def _read(x: np.ndarray, held: np.ndarray, d: Direction) -> np.ndarray:
    """Scores of one direction; ``held`` is 0 where a page has no block, which leaves the state empty."""
    h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    out = np.zeros(x.shape[:2], dtype=np.float32)
    for t in range(len(x)):
        _, _, o, _, c = _step(x[t], h, c, d)
        c = c * held[t]
        h = o * np.tanh(c)
        out[t] = h @ d.out
    return out


# --- training ------------------------------------------------------------------------------------------------


def _gradients(x: np.ndarray, held: np.ndarray, d: Direction, error: np.ndarray) -> tuple[Direction, np.ndarray]:
    """Gradients of one direction by back-propagation through the whole sequence, and that of its input."""
    steps, n, _ = x.shape
    h = c = np.zeros((n, HIDDEN), dtype=np.float32)
    kept = []
    for t in range(steps):
        i, f, o, g, new = _step(x[t], h, c, d)
        new = new * held[t]
        kept.append((i, f, o, g, h, c, new, np.tanh(new)))
        h, c = o * kept[-1][7], new
    grads = Direction(*(np.zeros_like(w) for w in d))
    d_x = np.zeros_like(x)
    d_h = d_c = np.zeros((n, HIDDEN), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, c_before, _, squashed = kept[t]
        grads.out[...] += (o * squashed).T @ error[t]
        d_h = d_h + error[t][:, None] * d.out
        d_c = (d_c + d_h * o * (1 - squashed**2)) * held[t]
        gates = np.concatenate([d_c * g * i * (1 - i), d_c * c_before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
        grads.inner[...] += x[t].T @ gates
        grads.state[...] += before.T @ gates
        grads.bias[...] += gates.sum(axis=0)
        d_x[t] = gates @ d.inner.T
        d_h, d_c = gates @ d.state.T, d_c * f
    return grads, d_x


class _Example(NamedTuple):
    names: np.ndarray
    words: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray


def _example(page: Page) -> _Example | None:
    found = blocks(page.html)
    if not found:
        return None
    buckets, first = word_buckets(found)
    counts = np.diff(first)
    names = np.zeros((len(found), NAMES), dtype=np.float32)
    words = np.zeros((len(found), WORDS), dtype=np.float32)
    for row, block in enumerate(found):
        names[row, path_buckets(block.path)] = 1
    np.add.at(words, (np.repeat(np.arange(len(found)), counts), buckets), 1)
    words /= np.maximum(counts, 1)[:, None]
    labels = np.array([block.text in page.kept for block in found], dtype=np.float32)
    return _Example(names, words, numbers_of(found, counts), labels)


def _batch(examples: list[_Example]) -> tuple[np.ndarray, ...]:
    size = max(len(e.labels) for e in examples)
    out = tuple(np.zeros((size, len(examples), width), dtype=np.float32) for width in (NAMES, WORDS, NUMBERS, 1, 1))
    for column, e in enumerate(examples):
        for whole, part in zip(out, (e.names, e.words, e.numbers, e.labels[:, None], np.ones((len(e.labels), 1))), strict=True):
            whole[: len(part), column] = part
    return out


def train(pages: list[Page], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller of ``pages`` whose main text is known."""
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    def direction() -> Direction:
        bias = np.zeros(4 * HIDDEN, dtype=np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        return Direction(drawn(DIM, 4 * HIDDEN), drawn(HIDDEN, 4 * HIDDEN), bias, drawn(HIDDEN))

    model = Labeller(drawn(NAMES, NAME_DIM, scale=0.3), drawn(WORDS, WORD_DIM, scale=0.3), direction(), direction(), np.zeros(1, np.float32))
    weights = [model.names, model.words, *model.ahead, *model.back, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    examples = sorted((e for e in map(_example, pages) if e), key=lambda e: len(e.labels))
    batches = [_batch(examples[i : i + BATCH]) for i in range(0, len(examples), BATCH)]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for b in rng.permutation(len(batches)):
            names, words, numbers, labels, held = batches[b]
            x = np.concatenate([names @ model.names, words @ model.words, numbers], axis=2)
            score = _read(x, held, model.ahead) + _read(x[::-1], held[::-1], model.back)[::-1] + model.bias
            error = (_sigmoid(score) - labels[:, :, 0]) * held[:, :, 0] / held.sum()
            ahead, d_ahead = _gradients(x, held, model.ahead, error)
            back, d_back = _gradients(x[::-1], held[::-1], model.back, error[::-1])
            d_x = d_ahead + d_back[::-1]
            flat = d_x.reshape(-1, DIM)
            grads = [names.reshape(-1, NAMES).T @ flat[:, :NAME_DIM], words.reshape(-1, WORDS).T @ flat[:, NAME_DIM : NAME_DIM + WORD_DIM], *ahead, *back, error.sum(keepdims=True)[0]]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def sample_words(pages: DataFrame, n: int = SAMPLE_PAGES) -> list[str]:
    """Words of up to ``n`` pages, the least by a hash of id and url: what layouts are filled with."""
    # Only about 8 n pages are sorted, so what comes to the driver does not grow with the table.
    share = min(1.0, 8 * n / max(1, pages.count()))
    hashed = pages.select("page_id", "url", "html").withColumn("hash", F.xxhash64("page_id", "url"))
    near = hashed.where(F.col("hash") <= int(share * 2**64) - 2**63 - 1).where(F.length("html") > 0)
    rows = near.orderBy("hash", "page_id", "url", "html").limit(n).collect()
    words = sorted({word for row in rows for block in blocks(row["html"]) for word in block.text.split()})
    step = max(1, len(words) // SAMPLE_WORDS)
    return words[::step]


def fit(pages: DataFrame, layouts: int = LAYOUTS) -> Labeller:
    """A labeller trained on ``layouts`` drawn pages with words of a sample of ``pages``."""
    words = sample_words(pages)
    if len(words) < 100:
        words = words + [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s", "tion", "lich")]
    return train(drawn_pages(SEED, layouts, words))


# --- extraction ------------------------------------------------------------------------------------------------


def _extractor(model: Labeller) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts: list[str] = []
            pages = [page if isinstance(page, str) else "" for page in part["html"]]
            ends = np.cumsum([len(page) for page in pages])
            for _, rows in groupby(range(len(pages)), key=lambda i: ends[i] // SLICE):
                found = [blocks(pages[i]) for i in rows]
                for page, scores in zip(found, model.scores(found), strict=True):
                    texts.append(" ".join(block.text for block, score in zip(page, scores.tolist(), strict=True) if score > 0))
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts})

    return run


def extracted(pages: DataFrame, model: Labeller) -> DataFrame:
    """``page_id, url, text``: the blocks of each page that are main text, in order, joined by one space."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInPandas(_extractor(model), "page_id long, url string, text string")
