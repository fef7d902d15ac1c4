"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks (html_blocks). A block's input is the mean of vectors of its hashed path names (tags,
words of class, id and role), the mean of vectors of its hashed words, and a few numbers; a bidirectional LSTM in numpy
reads the sequence, so each block is judged by the whole page. The weights (block_labeller.npz beside this file) are made by
train_blocks.py from pages that it composes out of texts and page parts; no page's own layout is written into this module.

Defined results: a null or empty page, and one without a block of main text, gives the empty text. Pages are read one by one:
repeated rows, ties, null ids, other columns and empty tables need no rule of their own. Every word of a block and every
block of a page counts, however long it is; time and memory are in proportion to the page.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .html_blocks import Block, Element, blocks

PATH_SLOTS, WORD_SLOTS, WIDTH, HIDDEN, NUMBERS = 1024, 2048, 16, 16, 8
INPUT = 2 * WIDTH + NUMBERS
#: Steps whose gates are computed at a time; blocks of pages that run together; words whose vectors are held at a time.
STEPS, TOGETHER, WORDS_HELD = 1024, 1 << 14, 1 << 16
#: Pages that are held at a time: so many, and so many characters.
PAGES, CHARACTERS = 256, 1 << 22
_WORDS = re.compile(r"\w+")


@lru_cache(1 << 16)
def word_slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_SLOTS


@lru_cache(1 << 14)
def path_slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_SLOTS


def word_slots(block: Block) -> list[int]:
    return list(map(word_slot, _WORDS.findall(block.text.lower()))) or [0]


def slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all path names and of all words."""
    return np.array(list(map(path_slot, block.path)) or [0]), np.array(word_slots(block))


def numbers(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), NUMBERS))
    for k, b in enumerate(page):
        n, words, depth = len(b.text), b.text.count(" ") + 1, b.element.depth if b.element else 0
        out[k] = (np.log1p(n) / 8, np.log1p(words) / 6, b.linked / n, k / len(page), 1 / (1 + k), 1 / (len(page) - k), sum(map(b.text.count, ".,;:!?")) / words, np.log1p(depth) / 3)
    return out


def path_mean(element: Element | None, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of the names above a block; elements keep their sums, so each is added up once."""
    if element is None:
        return vectors[0]
    chain, e = [], element
    while e is not None and e.sums is None:
        chain.append(e)
        e = e.above
    for e in reversed(chain):
        own = vectors[list(map(path_slot, e.names))].sum(axis=0)
        e.sums = own if e.above is None else e.above.sums + own
    return element.sums / element.depth


def word_means(page: list[Block], vectors: np.ndarray) -> np.ndarray:
    """The mean vectors of the blocks' words."""
    out, held, sizes = np.zeros((len(page), WIDTH)), [], []

    def add(first: int) -> None:
        of = np.repeat(np.arange(first, first + len(sizes)), sizes)
        own = vectors[held]
        for c in range(WIDTH):
            out[:, c] += np.bincount(of, own[:, c], len(page))

    total, first = np.zeros(len(page)), 0
    for k, b in enumerate(page):
        own = word_slots(b)
        total[k] = len(own)
        if len(own) > WORDS_HELD:  # a long block by itself: how often it has each slot
            out[k] += np.bincount(own, minlength=WORD_SLOTS) @ vectors
            own = []
        held += own
        sizes.append(len(own))
        if len(held) > WORDS_HELD:
            add(first)
            held, sizes, first = [], [], k + 1
    if held:
        add(first)
    return out / total[:, None]


def inputs(page: list[Block], w: dict[str, np.ndarray]) -> np.ndarray:
    x = np.empty((len(page), INPUT))
    for k, b in enumerate(page):
        x[k, :WIDTH] = path_mean(b.element, w["path"])
    x[:, WIDTH : 2 * WIDTH] = word_means(page, w["word"]) if page else 0
    x[:, 2 * WIDTH :] = numbers(page)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def run_lstm(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> np.ndarray:
    """Hidden states (2, steps, pages, HIDDEN) of both directions, the second one's in reversed order.

    Gates are in, forget, out and the new value, side by side. Shorter pages go on with zeros behind their end.
    """
    steps, n = max(map(len, pages)), len(pages)
    into, onto, bias = (np.stack([w[f"{k}f"], w[f"{k}b"]]) for k in "wub")
    h, c, out = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN)), np.empty((2, steps, n, HIDDEN))
    for a in range(0, steps, STEPS):
        x = np.zeros((2, min(STEPS, steps - a), n, INPUT))
        for k, page in enumerate(pages):
            for way, own in enumerate((page, page[::-1])):
                own = own[a : a + STEPS]
                x[way, : len(own), k] = own
        before = x @ into[:, None] + bias[:, None, None]
        for t in range(x.shape[1]):
            gates = before[:, t] + h @ onto
            opened, new = sigmoid(gates[..., : 3 * HIDDEN]), np.tanh(gates[..., 3 * HIDDEN :])
            c = opened[..., HIDDEN : 2 * HIDDEN] * c + opened[..., :HIDDEN] * new
            h = opened[..., 2 * HIDDEN :] * np.tanh(c)
            out[:, a + t] = h
    return out


def scores(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's inputs the probability of each block to be main text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        own = order[: max(1, sum(len(pages[k]) * (i + 1) <= TOGETHER for i, k in enumerate(order[:64])))]
        order = order[len(own) :]
        forth, back = run_lstm([pages[k] for k in own], w)
        for c, k in enumerate(own):
            n = len(pages[k])
            out[k] = sigmoid(forth[:n, c] @ w["of"] + back[:n, c][::-1] @ w["ob"] + pages[k] @ w["oi"] + w["o"])
    return out


def label(pages: list[list[Block]], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page which of its blocks are main text."""
    return [s >= 0.5 for s in scores([inputs(page, w) for page in pages], w)]


def load(path: str | None = None) -> dict[str, np.ndarray]:
    raw = files(__package__).joinpath("block_labeller.npz").read_bytes() if path is None else open(path, "rb").read()
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k].astype(float) for k in z.files}


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", weights_path: str | None = None) -> DataFrame:
    """(key, url, text, n_chars), a row for each of pages: the blocks of main text joined by line feeds."""
    w = load(weights_path)  # about 250 kB, sent with the function
    kinds = dict(pages.dtypes)

    def done(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(t) for t in part.column(2).to_pylist()]
        texts = ["\n".join(b.text for b, main in zip(page, own) if main) for page, own in zip(found, label(found, w))]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [key, url, "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) for t in batch.column(2).to_pylist()]
            at = held = 0
            for k, size in enumerate(sizes):
                if k > at and (k - at == PAGES or held + size > CHARACTERS):
                    yield done(batch.slice(at, k - at))
                    at, held = k, 0
                held += size
            if at < len(sizes):
                yield done(batch.slice(at))

    chosen = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), text_or_empty(pages, html).alias("the_html"))
    return chosen.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
