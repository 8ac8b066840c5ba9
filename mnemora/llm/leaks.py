"""Held-out items that stand, whole or in part, in corpus documents.

The fingerprint of a window is its SimHash: the majority, bit by bit, of its
words' hashes. A window's length follows from the item's. A quote of at least
``part`` of an item of L words with one word in ``noise`` replaced has n words
and k = n / noise strange ones, so it holds a clean run of (n - k) / (k + 1)
words, and at least n - k - (w - 1)(k + 1) windows of w words stand in it on
one diagonal. A longer quote can have shorter runs, as k steps up at multiples of
``noise``; the windows of an item are therefore the longest of ``sizes`` that a run
of its quotes of every length n is sure to hold, and the number of hits is the
least of all n. Item windows are indexed by the blocks of their fingerprints:
cut into ``radius`` + 1 blocks, any fingerprint within the radius agrees in one.
Pairs with as many hits on a diagonal as are sure are verified exactly, word by
word along the diagonal, words weighing their length; the stretch found must hold ``bar`` times ``part``
of the item, which is more than a third where ``part`` is a half.

Documents are read once and stay where they are; items are sent to the
executors in blocks of at most ``block_windows`` windows, each block a pass, so
what is broadcast is bounded whatever the number of items.

Of items of under ten words no word of a half may be replaced; a document must
hold half of such an item exactly.

Defined cases: null and empty texts and items hold nothing; equal rows give equal results; very long
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemora.llm.markup import without_accents, without_tags

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = re.compile(r"\\[nrt]|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_MARK = re.compile(r"[\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words between white space, in one case, without accents, punctuation and markup."""
    if not text:
        return []
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    text = without_accents(_BREAK.sub(" ", without_tags(text)).casefold())
    return [w for w in (_MARK.sub("", t) for t in text.split()) if w]


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each window of ``size`` words: bit by bit the majority of their hashes."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.uint16)  # differences are right although the sums wrap
    np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
    return np.packbits((sums[size:] - sums[:-size]) * 2 >= size, axis=1, bitorder="little").view(np.uint64).ravel()


class BlockIndex:
    """Fingerprints by their blocks: every one within ``radius`` of a query agrees with it in a block."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]
        self.tables = []
        for at, width in self.blocks:
            key = self._key(prints, at, width)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << width) + 1)).astype(np.int64)))

    @staticmethod
    def _key(prints: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) of all within the radius."""
        rows, cols = [], []
        for b, ((at, width), (order, starts)) in enumerate(zip(self.blocks, self.tables)):
            key = self._key(queries, at, width)
            n = starts[key + 1] - starts[key]
            some = np.flatnonzero(n)
            row = np.repeat(some, n[some])
            within = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            col = order[starts[key[row]] + within]
            x = queries[row] ^ self.prints[col]
            near = np.bitwise_count(x) <= self.radius
            for at2, width2 in self.blocks[:b]:  # a pair counts in the first block it agrees in
                near &= ((x >> np.uint64(at2)) & np.uint64((1 << width2) - 1)) != 0
            rows.append(row[near])
            cols.append(col[near])
        return np.concatenate(rows), np.concatenate(cols)


class Items:
    """Windows of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], *, part: float, noise: int, sizes: tuple[int, ...], radius: int, bar: float = 0.74):
        import xxhash

        self.noise = noise
        self.floor, self.ids, self.words = bar * part, [k for k, _ in items], [w for _, w in items]
        groups: dict[int, list[int]] = {}
        self.least = []
        for k, words in enumerate(self.words):
            size, least = self.sure(len(words), part, noise, sizes)
            groups.setdefault(size, []).append(k)
            self.least.append(least)
        self.classes = []
        for size, members in groups.items():
            prints, item, at = [], [], []
            for k in members:
                p = simhashes(np.array([xxhash.xxh64_intdigest(w) for w in self.words[k]], np.uint64), size)
                prints.append(p)
                item += [k] * len(p)
                at += range(len(p))
            self.classes.append((size, BlockIndex(np.concatenate(prints), radius), np.array(item, np.int64), np.array(at, np.int64)))

    @staticmethod
    def sure(length: int, part: float, noise: int, sizes: tuple[int, ...]) -> tuple[int, int]:
        """Window size and hits that quotes of every length of an item of ``length`` words are sure to have."""
        n = np.arange(-(-length // 2) if part == 0.5 else int(np.ceil(part * length)), length + 1)
        strange = n // noise
        clean = int((-(-(n - strange) // (strange + 1))).min())
        size = max((s for s in sizes if s <= clean), default=min(sizes))
        return size, max(1, int((n - strange - (size - 1) * (strange + 1)).min()))

    def find(self, docs: list[list[str]], known: dict[str, int]) -> list[tuple[int, int]]:
        """(document, item) of the verified quotes in a batch of documents' words."""
        import xxhash

        flat, starts = [], np.zeros(len(docs) + 1, np.int64)
        for k, words in enumerate(docs):
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
            starts[k + 1] = len(flat)
        hashes = np.array(flat, np.uint64)
        owner = np.repeat(np.arange(len(docs)), np.diff(starts))
        found: set[tuple[int, int]] = set()
        least = np.array(self.least, np.int64)
        for size, index, item, at in self.classes:
            prints = simhashes(hashes, size)
            inside = np.flatnonzero(owner[: len(prints)] == owner[size - 1 :][: len(prints)])
            if not len(inside):
                continue
            row, col = index.search(prints[inside])
            pos = inside[row]
            doc, k = owner[pos], item[col]
            diagonal = pos - starts[doc] - at[col] + (1 << 20)
            for shift in (0, 2):  # two grids of diagonals, so that a drift of a word or two stays in one of them
                key = (doc * len(self.ids) + k) * (1 << 30) + (diagonal + shift) // 4
                keys, n = np.unique(key, return_counts=True)
                pair = keys >> 30
                for p, d in zip(pair[n >= least[pair % len(self.ids)]], keys[n >= least[pair % len(self.ids)]] & ((1 << 30) - 1)):
                    doc_, k_ = int(p) // len(self.ids), int(p) % len(self.ids)
                    if (doc_, k_) not in found and self.verify(docs[doc_], self.words[k_], int(d) * 4 - shift - (1 << 20) + 2):
                        found.add((doc_, k_))
        return sorted(found)

    def verify(self, doc: list[str], item: list[str], diagonal: int, drift: int = 4, floor: float = 0.65) -> bool:
        """Whether a stretch along the diagonal holds enough of the item's words, equal by ``floor`` of their weight."""
        stretch = self.stretch(doc, item, diagonal, drift, floor)
        # strange words near a quote's ends cut the heaviest stretch short, so the bar lies under ``part``
        return stretch >= (self.floor * len(item) if len(item) >= self.noise else -(-len(item) // 2))

    @staticmethod
    def stretch(doc: list[str], item: list[str], diagonal: int, drift: int = 4, floor: float = 0.65) -> int:
        """Words of the item in the heaviest stretch: that of the greatest sum of equal weight over ``floor``."""
        last, score = -1, []
        for i, w in enumerate(item):
            lo = max(last + 1, i + diagonal - drift, 0)
            hit = next((j for j in sorted(range(lo, min(len(doc), i + diagonal + drift + 1)), key=lambda j: abs(j - i - diagonal)) if doc[j] == w), None)
            if hit is not None:
                last = hit
            weight = min(len(w), 6)
            score.append(weight * (1 - floor) if hit is not None else -weight * floor)
        best, run, begin, span = 0.0, 0.0, 0, (0, 0)
        for i, s in enumerate(score):
            if run <= 0:
                run, begin = 0.0, i
            run += s
            if run > best:
                best, span = run, (begin, i + 1)
        return span[1] - span[0]


def find_leaks(
    documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "context",
    part: float = 0.5, noise: int = 10, sizes: tuple[int, ...] = (1, 2, 3, 4, 6, 8), radius: int = 3, block_windows: int = 200_000,
) -> DataFrame:
    """(document key, item key) of every document that holds at least ``part`` of an item in one stretch."""
    spark = documents.sparkSession
    schema = T.StructType([documents.schema[key], items.schema[item_key]])
    blocks, block, size = [], [], 0
    for r in items.select(item_key, item_text).toLocalIterator():
        words = words_of(r[1])
        if words:
            block.append((r[0], words))
            size += len(words)
        if size >= block_windows:
            blocks.append(block)
            block, size = [], 0
    blocks += [block] if block else []
    result = spark.createDataFrame([], schema)
    for block in blocks:
        held = spark.sparkContext.broadcast(Items(block, part=part, noise=noise, sizes=sizes, radius=radius))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search, known = held.value, {}
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                if len(known) > 300_000:
                    known.clear()
                begin, size, docs, rows = 0, 0, [], []
                for k, t in enumerate(texts):
                    docs.append(words_of(t))
                    size += len(docs[-1])
                    if size > 60_000 or k + 1 == len(texts):  # bounds the matrices of bits
                        rows += [(keys[begin + d], search.ids[i]) for d, i in search.find(docs, known)]
                        begin, size, docs = k + 1, 0, []
                a, z = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, b.schema.field(0).type), pa.array(z, pa.int64())], names=[key, item_key])

        result = result.unionByName(documents.select(key, text).mapInArrow(run, schema))
    return result
