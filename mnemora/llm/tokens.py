"""Encoding with a public byte-level vocabulary, in length-bucketed padded matrices.

Pre-tokens of a batch are made unique and put into matrices by length class.
In every round each row merges its leftmost pair of least rank, and with it the
further occurrences of that same pair, which would come next as no merge makes
a pair of lower rank. Pairs are found by a hashed lookup of all neighbours at
once; merged rows are compacted to the left and finished rows leave the matrix.

Defined cases: null and empty texts give an empty list; text that looks like a
special token is ordinary text; texts are encoded whole, whatever their length;
equal rows give equal rows; key columns stay untouched, others are dropped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int32(2**31 - 1)
_CACHE = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies: below $TOKENIZERS_DIR, else the usual folder."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id), read for whole matrices."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[put], put, merged[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; slots of unknown pairs have the greatest rank."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, at, -1)
        open_ = np.nonzero((out < 0) & (self.keys[at] != -1) & (right >= 0))
        cur, want = at[open_], keys[open_]
        idx = np.arange(len(cur))
        for _ in range(self.probes):
            if not len(idx):
                break
            cur[idx] = (cur[idx] + 1) & (len(self.keys) - 1)
            here = self.keys[cur[idx]]
            hit = here == want[idx]
            sub = tuple(o[idx[hit]] for o in open_)
            out[sub] = cur[idx[hit]]
            idx = idx[~hit & (here != -1)]
        return out


class Encoder:
    """Byte-level pair encoding of many pre-tokens at once."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        self.bytes = np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.bytes[b] = vocab[letter]
        self.split = regex.compile(PATTERN).findall
        self.known = {}

    def _ranks(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.table.find(m[:, :-1], m[:, 1:])
        rank = np.where(slot >= 0, self.table.rank[slot], _NONE)
        return rank, slot

    def _rows(self, m: np.ndarray) -> np.ndarray:
        """Encode a matrix of byte ids, padded with -1; in place."""
        live, work = np.arange(len(m)), m
        while len(live) and work.shape[1] > 1:
            rank, slot = self._ranks(work)
            least = rank.min(axis=1)
            go = least != _NONE
            if not go.all():
                m[live[~go], : work.shape[1]] = work[~go]
                m[live[~go], work.shape[1] :] = -1
                live, work, rank, slot, least = live[go], work[go], rank[go], slot[go], least[go]
                if not len(live):
                    break
            hit = rank == least[:, None]
            # of touching occurrences (as in "aaa") every second one, from the left
            cols = np.arange(hit.shape[1])[None, :]
            hit &= (cols - np.maximum.accumulate(np.where(hit, -1, cols), axis=1)) % 2 == 1
            work = work.copy()
            row, col = np.nonzero(hit)
            work[row, col] = self.table.merged[slot[row, col]]
            keep = work >= 0
            keep[row, col + 1] = False
            place = np.cumsum(keep, axis=1)
            narrow = np.full((len(work), int(place[:, -1].max())), -1, np.int32)
            row, col = np.nonzero(keep)
            narrow[row, place[row, col] - 1] = work[row, col]
            work = narrow
        if len(live):
            m[live, : work.shape[1]] = work
            m[live, work.shape[1] :] = -1
        return m

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        width, lower = 1, 0
        while lower < size.max(initial=0):
            some = np.flatnonzero((size > lower) & (size <= width))
            for part in np.array_split(some, len(some) * width // 2_000_000 + 1) if len(some) else ():
                wide = int(size[part].max(initial=1))
                m = np.full((len(part), wide), -1, np.int32)
                flat = self.bytes[np.frombuffer(b"".join(raw[k] for k in part), np.uint8)]
                m[np.arange(wide)[None, :] < size[part][:, None]] = flat
                for k, ids in zip(part, self._rows(m)):
                    self.known[words[k]] = ids[ids >= 0].tolist()
            lower, width = width, width * 2

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > _CACHE:
            self.known.clear()
        new = list(dict.fromkeys(p for ps in parts for p in ps if p not in self.known))
        if new:
            self.learn(new)
        known = self.known
        lists = [list(chain.from_iterable([known[p] for p in ps])) for ps in parts]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1])))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) for every row of ``df``; one pass, no shuffle."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):  # bounds the memory a batch of long texts takes
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), e.encode(part.column(1).to_pylist())], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)
