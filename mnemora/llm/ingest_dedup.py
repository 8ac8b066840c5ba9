"""New batches against all accepted history, by content-defined chunks.

A text is cut where a rolling hash over its last two words says so, so an edit
moves only the boundaries beside it; one more hash stands for its set of words,
so that moved sentences are met too. A persistent table of the history leads from
each chunk to its first record and their number; a batch is looked up by its chunks.

A text's chunks are ranked from the rarest on, and it is looked up by those that
make up all but ``coverage`` of its bytes, so the commonest chunks need not be
joined. The first text of such a chunk is its leader; what shares at least
``least`` of its bytes with a leader of the history and proves near to it is a
duplicate in one linear pass, and so is a text of the same words as an earlier
one, whether that was accepted or not.

Chunks do not settle the others: words changed here and there leave few chunks
whole. These are compared by words, which misses nothing: in one order of all
words, common ones last, two texts near each other share a word among the first
of both (prefix filter). Texts that meet in a word are held against each other by
size and by a sketch of 128 bits, which differs in at most as many bits as the texts
in words, and then decided exactly, by the share of distinct words in both.
The order is kept beside the table, and any order gives the same results.

A text is accepted where it is near no accepted earlier one, which depends on
the texts before it. Leaders of large groups within a batch are compared first;
those near nothing earlier are accepted for certain, so a large group of reworked
copies does not meet in pairs; of exact copies a task keeps one. What remains
is resolved in rounds over links.

Defined cases: null and blank items are neither cases nor accepted; texts
without words are compared as they stand; equal texts after the first are
cases; an empty history or batch is allowed; whole texts are read; positions
must be under 2**24 and request ids under 2**37; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.llm.markup import without_accents, without_tags

_WORDS = re.compile(r"\w+").findall
_SIGNATURE = "id bigint, total int, chunks array<bigint>, sizes array<int>, n int, low bigint, high bigint, prefix array<bigint>, words array<bigint>"
_CHUNKS = "chunk bigint, lead bigint, df bigint"
_ORDER = 1 << 24
_MOST = 9  # words of the longest chunk
_POWERS = np.array([pow(0x9E3779B97F4A7C13, k, 1 << 64) for k in range(_MOST)], np.uint64)
_BROADCAST_ROWS = 400_000  # counted rows of one number up to which a side is sent to every executor: 3.2 MB


def _plain_words(text: str) -> list[str]:
    return _WORDS(without_accents(text.lower()))


def words_of(text: str) -> list[str]:
    """Words of a text: letters, digits and ``_``, without case, accents and tags."""
    return _plain_words(without_tags(text))


class Vocabulary(dict):
    """Numbers of the words in each run of characters without blanks, which is taken apart when first met.

    Blanks part words, and neither case nor accents look beyond them, so a text's
    words are those of its runs. ``key`` of a word is its hash under its place in
    the order, ``wide`` a wider hash and ``size`` its letters.
    """

    def __init__(self, place: dict[int, int], longest: int = 40):
        import xxhash

        self.place, self.longest = place, longest  # longer runs seldom come again
        self.narrow_hash, self.wide_hash = xxhash.xxh32_intdigest, xxhash.xxh64_intdigest
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.number: dict[str, int] = {}
        self.key, self.wide, self.size = array("q"), array("Q"), array("q")

    def __missing__(self, run: str) -> list[int]:
        number = self.number
        words = (run.lower(),) if run.isascii() and run.isalnum() else _plain_words(run)
        out = [number[w] if w in number else self._add(w) for w in words]
        if len(run) <= self.longest:
            self[run] = out
        return out

    def _add(self, word: str) -> int:
        h = self.narrow_hash(word)
        self.key.append(self.place.get(h, 0) << 32 | h)  # sorts in the order; cut() reads the lower 32 bits
        self.wide.append(self.wide_hash(word))
        self.size.append(len(word))
        k = self.number[word] = len(self.number)
        return k

    def words(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, without_tags(text).split()))


def cut(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, *, divisor: int = 3, least: int = 3, most: int = _MOST) -> np.ndarray:
    """Where the chunks begin in texts that lie one behind another: a boundary where the rolling hash of two words is a multiple of ``divisor``."""
    at = np.arange(len(hashes))
    before = np.roll(hashes, 1)
    before[begins[begins < ends]] = 0
    mark = (((hashes * 31 + before) & 0xFFFFFFFF) >> 7) % divisor == 0
    marked = np.minimum.accumulate(np.where(mark, at, len(at))[::-1])[::-1]  # the first boundary from a word on
    marked = np.append(marked[least - 1 :], np.full(least - 1, len(at)))[: len(at)]
    after = (np.minimum(marked, at + most - 1) + 1).tolist()
    out = []
    for a, z in zip(begins.tolist(), ends.tolist()):
        while a < z:
            out.append(a)
            a = after[a]
    return np.array(out, np.int64)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def common_words(texts: DataFrame, *, most: int = 20_000, one_in: int = 8) -> list[int]:
    """Hashes of the most frequent words of a sample of the texts, from the rarest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary({})
        n: Counter[int] = Counter()
        for b in batches:
            if len(known) > 300_000:
                known.clear()
            for t in b.column(0).to_pylist():
                n.update(set(known.words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([known.key[k] for k in n], pa.int64()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    sample = texts.where(_solid() & (F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)).select("text")
    rows = sample.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()  # at most ``most`` rows
    return [r.word for r in rows][::-1]


def first_words(n: int, share: float) -> int:
    """How many of a text's n words must be looked at to meet one of any ``share`` of them."""
    return n - math.ceil(n * share - 1e-9) + 1


class Signer:
    """Signatures of texts, many at a time: their words are numbered, and the rest is done on arrays of the numbers."""

    def __init__(self, place: dict[int, int], near: float, *, kept: int = 300_000, words: int = 300_000, rows: int = 4096):
        self.known, self.near, self.kept, self.most_words, self.most_rows = Vocabulary(place), near, kept, words, rows
        self.firsts: dict[int, int] = {0: 0}
        self.bits = 32 + max(place.values(), default=0).bit_length()  # of a key; a text's place among ``rows`` lies above them

    def batches(self, ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Signatures in batches of about ``words`` words; a text is read whole."""
        flat, ends, a = [], [], 0
        for k, text in enumerate(texts, 1):
            flat.extend(self.known.words(text))
            ends.append(len(flat))
            if k == len(texts) or len(flat) >= self.most_words or k - a >= self.most_rows:
                yield self._batch(ids[a:k], texts[a:k], np.array(flat, np.int64), np.array(ends, np.int64))
                flat, ends, a = [], [], k
                if len(self.known) > self.kept or len(self.known.number) > self.kept:
                    self.known.forget()

    def _batch(self, ids: list[int], texts: list[str], flat: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        import xxhash

        key, wide, size = (np.array(x) for x in (self.known.key, self.known.wide, self.known.size))
        lists = lambda values, counts: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))
        every = np.arange(len(ids))
        begins = np.append(0, ends[:-1])
        # words of one hash stay two and lie side by side, so the order is one of words all the same
        distinct = np.sort(np.repeat(every, ends - begins) << 32 | flat)
        distinct = distinct[np.diff(distinct, prepend=-1) != 0]
        of, distinct = distinct >> 32, distinct & 0xFFFFFFFF
        n = np.bincount(of, minlength=len(ids))
        tokens = np.sort(of << self.bits | key[distinct]) & ((1 << self.bits) - 1)
        some = np.flatnonzero(n)
        edges = (np.cumsum(n) - n)[some]
        bit, upper = np.uint64(1) << (tokens & 63).astype(np.uint64), tokens & 64 != 0
        low, high, same = (np.zeros(len(ids), np.uint64) for _ in range(3))
        if len(some):
            low[some] = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), edges)
            high[some] = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), edges)
            # texts of the same words, in any order, share a chunk of no bytes of its own
            same[some] = _mixed(np.add.reduceat(wide[distinct], edges), 1)
        for k in np.flatnonzero(n == 0):
            same[k] = xxhash.xxh64_intdigest("\0" + texts[k])

        starts = cut(key[flat] & 0xFFFFFFFF, begins, ends)
        length = np.diff(starts, append=len(flat))
        pieces, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(starts):
            pieces = _mixed(np.add.reduceat(wide[flat] * _POWERS[np.arange(len(flat)) - np.repeat(starts, length)], starts), 0)
            sizes = np.add.reduceat(size[flat], starts) + length - 1
        text = np.append(np.searchsorted(ends, starts, side="right"), every)
        pieces, sizes = np.append(pieces, same), np.append(sizes, np.zeros(len(ids), np.int64))
        by = np.lexsort((pieces, text))
        by = by[np.append(True, (np.diff(text[by]) != 0) | (np.diff(pieces[by]) != 0))]  # a text's chunk once
        text, pieces, sizes = text[by], pieces[by], sizes[by]

        for k in set(n.tolist()) - self.firsts.keys():
            self.firsts[k] = first_words(k, self.near)
        first = np.minimum([self.firsts[k] for k in n.tolist()], n)
        prefix = tokens[np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(first, n)]
        words = np.zeros(int(np.maximum(n, 1).sum()), np.uint64)
        worded = np.repeat(n > 0, np.maximum(n, 1))
        words[worded], words[~worded] = wide[distinct], same[n == 0]
        columns = {
            "id": pa.array(ids, pa.int64()),
            "total": pa.array(np.bincount(text, sizes, len(ids)).astype(np.int32)),
            "chunks": lists(pieces.view(np.int64), np.bincount(text, minlength=len(ids))),
            "sizes": lists(sizes.astype(np.int32), np.bincount(text, minlength=len(ids))),
            "n": pa.array(n.astype(np.int32)),
            "low": pa.array(low.view(np.int64)),
            "high": pa.array(high.view(np.int64)),
            "prefix": lists(prefix, first),
            "words": lists(words.view(np.int64), np.maximum(n, 1)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def signatures(texts: DataFrame, order: list[int], *, near: float = 0.7, kept: int = 1_000_000) -> DataFrame:
    """(id, total, chunks, sizes, n, low, high, prefix, words) of (id, text); null and blank texts fall away.

    ``n`` counts the distinct words, ``prefix`` holds the first of them in the
    order of ``order``, ``low`` and ``high`` the parities of their hashes and
    ``words`` a wider hash of each; of a text without words, that of the text.

    Of texts a task has met before, as long as it is among the last ``kept``,
    only those with a lesser id give a row again: a group of copies is a row or
    so for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = Signer(held.value, near)
        met: dict[int, int] = {}
        for b in batches:
            if len(met) > kept:
                met.clear()
            ids, new = [], []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                same = xxhash.xxh64_intdigest(text)
                if met.get(same, id_ + 1) > id_:
                    met[same] = id_
                    ids.append(id_)
                    new.append(text)
            yield from signer.batches(ids, new)

    held = texts.sparkSession.sparkContext.broadcast({h: k + 1 for k, h in enumerate(order)})

    return texts.where(_solid()).mapInArrow(run, _SIGNATURE)


def sketch_pairs(word, id_, n, low, high, pos, asked, near: float, small: int = 200):
    """(id, other) that may be near, of rows sorted by word and n: one of them asked, a word in both prefixes, sizes, sketches and places close enough.

    Of the words that two texts share, one is the first in both. What lies from
    there on must hold all that they share, so a row's place ``pos`` bounds the
    words of the other text (``most``).
    """
    out_a, out_b = [], []
    differ = (1 - near) / (1 + near)
    allowed = np.minimum(np.floor(np.arange(2 * int(n.max(initial=0)) + 1) * differ + 1e-6), 255).astype(np.uint8)
    most = np.minimum(np.floor(n / near + 1e-6), np.floor((n - pos) * (1 + near) / near + 1e-6) - n).astype(np.int64)
    first = most >= n  # can be the shorter text

    def keep(i, j) -> None:
        out_a.append(id_[i])
        out_b.append(id_[j])

    edge = np.flatnonzero(np.diff(word, prepend=word[:1] - 1)) if len(word) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(word))
    length = ends - edge
    end = np.repeat(ends, length)
    i = np.flatnonzero(np.repeat(length <= small, length) & first)
    for s in range(1, small):
        i = i[i + s < end[i]]
        i = i[n[i + s] <= most[i]]  # rows further on are longer still
        if not len(i):
            break
        x = i[(n[i] <= most[i + s]) & (asked[i] | asked[i + s])]
        y = x + s
        near_ = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= allowed[n[x] + n[y]]
        keep(x[near_], y[near_])
    for a, z in zip(edge[length > small], ends[length > small]):
        every = np.arange(a, z)
        some = every[asked[a:z]]
        short = every[first[a:z]]
        for xs, ys in ((short[asked[short]], every), (short[~asked[short]], some)):
            if not len(xs) or not len(ys):
                continue
            # rows of much the same size and bound are held against the others together
            xs = xs[np.lexsort((most[xs], n[xs] >> 2))]
            blocks = np.flatnonzero(np.diff(n[xs] >> 2, prepend=-1))
            for b, e in zip(blocks, np.append(blocks[1:], len(xs))):
                for at in range(b, e, 64):
                    x = xs[at : min(at + 64, e)]
                    k, longest = n[x].min(), n[x].max()
                    y = ys[np.searchsorted(n[ys], k) : np.searchsorted(n[ys], most[x].max(), side="right")]
                    y = y[most[y] >= k]
                    bound, ly, hy, ny, my = allowed[longest + n[y]], low[y], high[y], n[y], most[y]
                    step = max(1, 60_000 // max(1, len(y)))
                    for c in range(0, len(x), step):
                        part = x[c : c + step]
                        differing = np.bitwise_count(low[part][:, None] ^ ly)
                        differing += np.bitwise_count(high[part][:, None] ^ hy)
                        at_ = np.flatnonzero(differing <= bound)
                        r, q = np.divmod(at_, max(1, len(y)))
                        i, j = part[r], y[q]
                        near_ = (differing.ravel()[at_] <= allowed[n[i] + ny[q]]) & (n[i] <= ny[q]) & (ny[q] <= most[i]) & (n[i] <= my[q])
                        keep(i[near_], j[near_])
    if not out_a:
        return np.zeros((2, 0), np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    pairs = np.stack([np.maximum(a, b), np.minimum(a, b)])[:, a != b]
    return np.unique(pairs, axis=1) if pairs.shape[1] else pairs


def word_pairs(rows: DataFrame, asked: Column, near: float, words: DataFrame | None = None) -> DataFrame:
    """(id, other), other < id: every pair of signatures whose words can agree by ``near``, one of them asked; and some besides.

    ``words`` holds those of the asked where they are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            word, id_, low, high, place = (t.column(c).to_numpy() for c in ("word", "id", "low", "high", "place"))
            a, b = sketch_pairs(word, id_, place >> 32, low.view(np.uint64), high.view(np.uint64), (place & 0xFFFFFFFF) >> 1, place & 1 == 1, near)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "other"])

        for b in batches:
            if not b.num_rows:
                continue
            word = b.column(0).to_numpy()
            at = int(np.searchsorted(word, word[-1]))  # where the last word, which may go on, begins
            if at or (held and held[-1].column(0)[-1].as_py() != word[0]):
                if held or at:
                    yield pairs([*held, b.slice(0, at)] if at else held)
                held = []
            held.append(b.slice(at))
        if held:
            yield pairs(held)

    # n, the word's place and whether the text is asked in one number, by which rows are sorted too
    head = F.shiftleft(F.col("n").cast("bigint"), 32) + asked.cast("bigint")
    t = rows.select("id", "low", "high", head.alias("head"), F.posexplode("prefix").alias("pos", "word")).select("word", (F.col("head") + F.col("pos") * 2).alias("place"), "id", "low", "high")
    t = t if words is None else t.join(_few(words), "word", "left_semi")
    return t.repartition("word").sortWithinPartitions("word", "place").mapInArrow(run, "id bigint, other bigint").distinct()


def chunk_table(signed: DataFrame) -> DataFrame:
    """(chunk, lead, df): of each chunk the first record that holds it and how many do; combined before the shuffle, so a common chunk is one row a task."""
    return signed.select("id", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.min("id").alias("lead"), F.count("*").alias("df"))


def _is_few(df: DataFrame) -> bool:
    return df.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS


def _few(df: DataFrame) -> DataFrame:
    """``df`` of one number a row with a broadcast hint where it is counted to be small."""
    return F.broadcast(df) if _is_few(df) else df


def _solid() -> Column:
    return F.regexp_like("text", F.lit(r"\S"))


def order_of(request: str, pos: str) -> Column:
    """Ids of items in the order they are compared in."""
    return F.col(request).cast("bigint") * _ORDER + F.col(pos)


class History:
    """Accepted texts in tables of parquet parts under a manifest; a batch is added by one rename.

    A part holds the signatures of its texts and beside them its chunk table,
    from each chunk to its first record and their number. A batch is joined to
    the chunk tables by its own chunks and to the signatures by its own words:
    what does not match falls away in the scan of the history, where the batch's
    side is small, and before anything of it is compared in any case. Texts are
    not read again.
    """

    def __init__(self, spark: SparkSession, path: str, *, near: float = 0.7, coverage: float = 0.2, least: float = 0.08, group: int = 32):
        self.spark, self.path, self.near, self.coverage, self.least, self.group = spark, path, near, coverage, least, group

    def _parts(self) -> list[str]:
        return (workspace.read_json(self.spark, f"{self.path}/manifest.json") or {"parts": []})["parts"]

    def _order(self, texts: DataFrame) -> list[int]:
        """The order of words, which the first texts set for good."""
        kept = workspace.read_json(self.spark, f"{self.path}/order.json")
        if kept is None:
            kept = {"words": common_words(texts)}
            workspace.replace_json(self.spark, f"{self.path}/order.json", kept)
        return kept["words"]

    def _add(self, signed: DataFrame) -> None:
        part = f"{self.path}/part-{len(self._parts())}"
        signed.write.mode("overwrite").parquet(f"{part}/texts")
        chunk_table(self.spark.read.schema(_SIGNATURE).parquet(f"{part}/texts")).write.mode("overwrite").parquet(f"{part}/chunks")
        workspace.replace_json(self.spark, f"{self.path}/manifest.json", {"parts": [*self._parts(), part]})

    def accept(self, texts: DataFrame) -> "History":
        """Take the ``text`` rows as accepted without comparing them."""
        # history comes before every item: its ids are negative, made of the text, so that copies have one
        named = texts.select((-1 - F.xxhash64("text").bitwiseAND((1 << 62) - 1)).alias("id"), "text")
        self._add(signatures(named, self._order(named), near=self.near))
        return self

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(schema).parquet(*(f"{p}/{what}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read("texts", _SIGNATURE)

    def check(self, items: DataFrame, *, append: bool = True) -> DataFrame:
        """(id) of the items (id, text) that are duplicates or near-duplicates; the others join the history where ``append``."""
        items = items.select("id", "text").where(_solid())
        batch = workspace.materialise(signatures(items, self._order(items), near=self.near), "batch")
        mine = batch.select(F.explode("chunks").alias("chunk"), F.col("id").alias("lead"), F.lit(1).cast("bigint").alias("df"), F.lit(True).alias("mine"))
        theirs = self._read("chunks", _CHUNKS).withColumn("mine", F.lit(False))
        if _is_few(mine):
            theirs = theirs.join(F.broadcast(mine.select("chunk")), "chunk", "left_semi")
        # otherwise the history's chunks of no text of the batch fall away where both meet, with no join before
        stats = mine.unionByName(theirs).groupBy("chunk").agg(F.min("lead").alias("lead"), F.sum("df").alias("df"), F.max("mine").alias("mine")).where("df > 1 and mine").drop("mine")
        shared = (
            batch.select("id", "total", F.explode(F.arrays_zip("chunks", "sizes")).alias("c"))
            .select(F.col("c.chunks").alias("chunk"), "id", "total", F.col("c.sizes").alias("size"))
            .join(stats, "chunk")
        )
        # chunks of no other text come first in a text's ranking, so before a chunk lies all but it and the commoner ones
        onward = F.sum("size").over(Window.partitionBy("id").orderBy(F.desc("df"), F.desc("chunk")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        probes = workspace.materialise(
            shared.withColumn("rank", F.col("total") - onward)
            .where(((F.col("size") == 0) | (F.col("rank") <= (1 - self.coverage) * F.col("total"))) & (F.col("lead") < F.col("id")))
            .select("id", "chunk", "lead", "size", "total"),
            "probes",
        )
        everything = self.read().unionByName(batch)
        leads = workspace.materialise(self._covered(probes.select("id", F.col("lead").alias("other"), "size", "total")), "leads")
        # history is accepted, and what has the words of an earlier text is near whatever that one is near
        same = probes.where("size = 0").select("id", F.col("lead").alias("other"))
        plain = workspace.materialise(self._near(leads.where("other < 0").unionByName(same).distinct(), everything).select("id").distinct(), "plain")
        plain = self._large_groups(leads.where("other >= 0").join(plain, "id", "left_anti"), plain, everything)
        open_ = batch.join(plain, "id", "left_anti")
        asked = workspace.materialise(open_.select(F.explode("prefix").alias("word")).distinct(), "words")
        links = workspace.materialise(self._near(word_pairs(self.read().unionByName(open_), F.col("id") >= 0, self.near, asked), everything), "links")
        by_history = plain.unionByName(links.where("other < 0").select("id")).distinct()
        rejected = self._resolve(links.where("other >= 0"), workspace.materialise(by_history, "rejected"))
        accepted = batch.join(rejected, "id", "left_anti")
        if append:
            # items keep their place before later ones: below every id to come, above none of the history's
            self._add(accepted.withColumn("id", F.col("id") - (1 << 62)).select(*batch.columns))
        return items.select("id").join(accepted.select("id"), "id", "left_anti")

    def _large_groups(self, leads: DataFrame, plain: DataFrame, everything: DataFrame) -> DataFrame:
        """``plain`` and the texts near a leader of more than ``group`` texts that is near nothing earlier itself."""
        large = leads.groupBy("other").count().where(F.col("count") > self.group).select(F.col("other").alias("id"))
        large = workspace.materialise(large.join(plain, "id", "left_anti").withColumn("large", F.lit(True)), "large")
        if large.isEmpty():
            return plain
        rows = everything.join(plain, "id", "left_anti").join(large, "id", "left")
        words = rows.where("large").select(F.explode("prefix").alias("word")).distinct()
        met = word_pairs(rows, F.coalesce("large", F.lit(False)), self.near, words).join(large, "id", "left_semi")
        certain = large.join(self._near(met, everything), "id", "left_anti").select(F.col("id").alias("other"))
        near = self._near(leads.join(certain, "other", "left_semi").select("id", "other"), everything)
        return workspace.materialise(plain.unionByName(near.select("id").distinct()).distinct(), "plain")

    def _covered(self, hits: DataFrame) -> DataFrame:
        """Pairs whose shared chunks among those looked up make up at least ``least`` of the text."""
        return hits.groupBy("id", "other").agg(F.sum(F.when(F.col("size") == 0, F.col("total")).otherwise(F.col("size"))).alias("size"), F.max("total").alias("total")).where(F.col("size") >= self.least * F.col("total")).select("id", "other")

    def _near(self, pairs: DataFrame, signed: DataFrame) -> DataFrame:
        """The pairs (id, other) whose distinct words agree in at least ``near`` of those in either."""
        pairs = workspace.materialise(pairs, "pairs")
        wanted = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
        # the words of the texts wanted, once each; those of the history are met in its scan where they are few
        words = signed.select("id", "words").join(_few(wanted), "id", "left_semi").dropDuplicates(["id"])
        both = F.size(F.array_intersect("words", "other_words"))
        union = F.size("words") + F.size("other_words") - both
        return (
            pairs.join(words, "id")
            .join(words.select(F.col("id").alias("other"), F.col("words").alias("other_words")), "other")
            .where(both >= F.ceil(union * self.near - 1e-9))
            .select("id", "other")
        )

    def _resolve(self, links: DataFrame, rejected: DataFrame) -> DataFrame:
        """Texts near an accepted earlier one: per round, those whose earlier neighbours are all settled.

        Rounds are as many as the longest chain of texts each near the one
        before but not to those accepted; each handles the links still open.
        """
        while True:
            gone = rejected.select(F.col("id").alias("other"))
            links = workspace.materialise(links.join(rejected, "id", "left_anti").join(gone, "other", "left_anti"), "open")
            if links.isEmpty():
                return rejected
            open_ = links.select(F.col("id").alias("other")).distinct()
            near = links.join(open_, "other", "left_anti").select("id").distinct()
            rejected = workspace.materialise(rejected.unionByName(near), "rejected")
