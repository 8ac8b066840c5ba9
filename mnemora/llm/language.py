"""Languages of texts and of the stretches of mixed ones, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public byte
vocabulary. The probability of a word is the sum over all ways to cut it into
pieces, found by the forward algorithm for whole blocks of words at a time; a
sentence's is the product over its words. A Viterbi pass over the sentences of
a text, with a price for changing language, gives the stretches. A stretch that
a model with equal probabilities for all pieces explains better, by a margin, is
``other``: text of a language nothing was learnt of. The confidence of a stretch
is the posterior of its language under equal priors, at a temperature set on
fragments of sentences that were kept out of the counts, times the odds that the
stretch is as familiar, word by word, as such sentences are.

The pieces' probabilities are learnt by expectation maximisation (forward and
backward sums) from the text's own labels, which also say what languages there
are. Labels are partly wrong, so sampled sentences are labelled again by the
model and it is learnt once more. The sample is bounded: at most ``per_label``
records of each label, chosen by a hash of the text, and ``per_text`` sentences
of each; the model holds one number per piece and language.

Defined cases: null and empty texts, and texts without words of a language
(numbers, code, links, names alone) have no stretch; unknown or missing labels
count as missing; where no row is labelled every stretch is ``und``; letters of other scripts and missing accents are learnt from
written-over copies of the words; texts and words of any length are read whole;
repeated rows give equal results; other columns stay untouched.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm import pii

#: Names of languages (fixed values): two letters, three letters, English.
NAMES = {
    "en": "en eng english", "ru": "ru rus russian", "de": "de deu ger german", "es": "es spa spanish", "fr": "fr fra fre french",
    "uk": "uk ukr ukrainian", "pt": "pt por portuguese", "it": "it ita italian", "pl": "pl pol polish", "nl": "nl nld dut dutch",
    "zh": "zh zho chi chinese", "ja": "ja jpn japanese", "ar": "ar ara arabic", "tr": "tr tur turkish", "sv": "sv swe swedish", "cs": "cs ces cze czech",
}
UNKNOWN = "und unknown unk none null n/a na mul mis zxx xx other ? - auto"

#: Transliteration of Cyrillic letters (fixed values).
LATIN = dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщъыьэюяё", "a b v h g d e ye zh z y i yi y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya yo".split(" ")))
LATIN_RU = LATIN | {"г": "g", "и": "i"}

SWITCH = 7.0  # nats a change of language costs
OTHER = "other"  # the outcome where no language learnt explains a stretch
OTHER_WORDS = 6  # words a stretch must have to be called that
NOVEL = 0.25  # weight of the evidence of words unknown to all languages
MARGIN = -1.5  # nats a word by which all languages must at least fall short of equal pieces
CLIP = 8.0  # nats a word may speak against a language, so that one odd word does not outweigh a sentence


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where a public vocabulary lies: below $TOKENIZERS_DIR, else the usual folder."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> frozenset[bytes]:
    """Every piece of a vocabulary, and every single byte."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return frozenset(pieces) | frozenset(bytes([b]) for b in range(256))


def label_of(c: str | Column) -> Column:
    """Normal form of a label: a two-letter code, null where missing or unknown, the label itself where it is none of ours."""
    c = F.col(c) if isinstance(c, str) else c
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([^-_]*)", 1)
    whole = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)))
    missing = (whole == "") | whole.isin(*UNKNOWN.split())
    return F.when(c.isNull() | missing, None).otherwise(F.coalesce(F.try_element_at(known, base), base))


# --- text

_CODE = re.compile(r"`[^`]*`|https?://\S+|www\.\S+|\S*@\S*|<[^<>]{1,200}>|\S*[/\\=_]\S*[\w/]|\S*\d\S*|&\w+;")
_MAY_BE_CODE = re.compile(r"[`@/\\=_<&]|\d|www\.", re.I).search
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\s*\n\s*|\s+/\s+")


def sentences(text: str, given: frozenset[str] = frozenset()) -> list[list[str]]:
    """Words of each sentence, in lower case, without personal items, code, links and tokens that hold digits."""
    items = pii.find_items(text, given)
    if items:
        text = "".join(text[a:b] + " " for a, b in zip([0, *(z for _, _, z in items)], [*(a for _, a, _ in items), len(text)]))
    parts = _SENTENCE.split(text)
    if _MAY_BE_CODE(text):
        parts = [_CODE.sub(" ", s) if _MAY_BE_CODE(s) else s for s in parts]
    return [_WORD.findall(s.lower()) for s in parts]


# --- model


class PieceModel:
    """Piece probabilities of each language, and the sums over segmentations.

    Pieces are found by a polynomial hash of their bytes (with their length in
    it), in one sorted table, for whole blocks of words at a time.
    """

    def __init__(self, langs: tuple[str, ...], pieces: list[bytes], probs: np.ndarray, temperature: float = 1.0, margin: float = -np.inf, usual: float = np.inf, given: frozenset[str] = frozenset()):
        self.langs, self.temperature, self.margin, self.usual, self.given = langs, temperature, margin, usual, given
        self.longest, self.plain = max(map(len, pieces), default=1), float(np.log(max(2, len(pieces))))
        keys = _hashes(pieces)
        order = np.argsort(keys)
        self.keys, self.probs, self.pieces = keys[order], np.asarray(probs, float)[order], [pieces[k] for k in order]
        self._seen: dict[str, int] = {}
        self._scores = np.zeros((0, self.probs.shape[1]))

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_scores": np.zeros((0, self.probs.shape[1])), "pieces": None}

    def _hits(self, prefix: np.ndarray, rows: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, length, piece) of the pieces that end before byte j, by row."""
        length = np.arange(1, min(j, self.longest) + 1)
        h = (prefix[rows, j][:, None] - prefix[rows[:, None], j - length[None, :]] * _POWERS(length)[None, :]) * _MIX + length.astype(np.uint64)[None, :]
        at = np.minimum(np.searchsorted(self.keys, h.ravel()), len(self.keys) - 1).reshape(h.shape)
        r, k = np.nonzero(self.keys[at] == h)
        return rows[r], length[k], at[r, k]

    def forward(self, raw: list[bytes]) -> np.ndarray:
        """Log of the summed probability, per language, of all segmentations of each byte string.

        The sums are scaled per row and language as they go, so strings of any
        length are summed whole.
        """
        size, out = np.fromiter(map(len, raw), np.int64, len(raw)), np.zeros((len(raw), self.probs.shape[1]))
        for block in _blocks(size):
            n, prefix = size[block], _prefix_hashes([raw[k] for k in block])
            alpha = np.zeros((len(block), prefix.shape[1], self.probs.shape[1]))
            alpha[:, 0] = 1.0
            scale = np.zeros((len(block), self.probs.shape[1]))
            for j in range(1, prefix.shape[1]):
                row, length, piece = self._hits(prefix, np.flatnonzero(n >= j), j)
                if len(row):
                    part = alpha[row, j - length] * self.probs[piece]
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    alpha[row[first], j] = np.add.reduceat(part, first, axis=0)
                if j % 16 == 0:
                    window = alpha[:, max(0, j + 1 - self.longest) : j + 1]
                    top = np.maximum(window.max(axis=1), 1e-290)
                    window /= top[:, None]
                    scale += np.log(top)
                done = np.flatnonzero(n == j)
                if len(done):
                    out[block[done]] = np.log(np.maximum(alpha[done, j], 1e-300)) + scale[done]
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, per language; those met before are looked up."""
        if len(self._seen) > 300_000:
            self._seen, self._scores = {}, self._scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in self._seen]
        if new:
            n = len(self._seen)
            self._seen.update(zip(new, range(n, n + len(new))))
            if len(self._scores) < n + len(new):
                self._scores = np.concatenate([self._scores[:n], np.zeros((max(n, len(new)), self.probs.shape[1]))])
            scores = self.forward([_bytes_of(w) for w in new])
            known = scores[:, : len(self.langs)]
            best = known.max(axis=1, keepdims=True)
            # what is less likely than two pieces of an equal share is a name or a word nobody has learnt: weak evidence
            known[:] = np.where(best < -2 * self.plain, best - NOVEL * (best - known), known)
            np.maximum(known, best - CLIP, out=known)
            self._scores[n : n + len(new)] = scores
        return self._scores[[self._seen[w] for w in words]]

    def sentences(self, sentences: list[list[str]]) -> np.ndarray:
        """Summed log probabilities of the words of each sentence; no sentence may be empty."""
        if not sentences:
            return np.zeros((0, self.probs.shape[1]))
        starts = np.cumsum([0, *map(len, sentences)])[:-1]
        return np.add.reduceat(self.words([w for s in sentences for w in s]), starts, axis=0)

    def stretches(self, texts: list[str | None], min_words: int = 2) -> list[list[tuple[str, float]]]:
        """For each text (language, confidence) of each longest run of sentences in one language, in text order."""
        parts = [[p for p in sentences(t or "", self.given) if p] for t in texts]
        parts = [p if _long_words(p, min_words) else [] for p in parts]
        size = np.array([len(x) for p in parts for x in p], np.int64)
        out: list[list[tuple[str, float]]] = [[] for _ in parts]
        if not len(size):
            return out
        scores = self.sentences([x for p in parts for x in p])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        # a lone word is weak evidence, often a name: it can't change the language by itself
        weight = np.where(size > 1, 1.0, 0.3)
        best = scores[:, : len(self.langs)].argmax(axis=1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner))
        for a, z in zip(first, last):
            if z - a > 1 and (best[a:z] != best[a]).any():  # else no change of language can pay
                best[a:z] = _viterbi((scores[a:z, : len(self.langs)] * weight[a:z, None]).tolist())
        begin = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
        sums = np.add.reduceat(scores * weight[:, None], begin, axis=0)
        names, sure = self._judge(best[begin], sums, np.add.reduceat(size * weight, begin))
        for text, name, c in zip(owner[begin].tolist(), names, sure.tolist()):
            runs = out[text]
            if runs and runs[-1][0] == name:  # stretches of unknown languages side by side
                c = max(c, runs.pop()[1])
            runs.append((name, c))
        return out

    def _judge(self, k: np.ndarray, s: np.ndarray, words: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the confidence of stretches, ``other`` where no language explains the words."""
        known = s[:, : len(self.langs)]
        own = known[np.arange(len(k)), k]
        sure = 1.0 / np.exp(np.clip((known - own[:, None]) / self.temperature, -700, 700)).sum(axis=1)
        names = [self.langs[i] for i in k]
        if s.shape[1] > len(self.langs):
            lead = own - s[:, -1]
            if np.isfinite(self.usual):
                sure /= 1.0 + np.exp(np.clip(6.0 * (0.5 - lead / np.maximum(words, 1.0) / self.usual), -700, 700))
            lack = self.margin * words - lead
            for i in np.flatnonzero((lack > 0) & (words >= OTHER_WORDS)):
                names[i], sure[i] = OTHER, 1.0 / (1.0 + np.exp(-min(lack[i] / self.temperature, 700.0)))
        return names, sure

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, per language, over all segmentations of words met ``counts`` times: one E-step."""
        raw = [_bytes_of(w) for w in words]
        size, langs = np.fromiter(map(len, raw), np.int64, len(raw)), self.probs.shape[1]
        total = np.zeros(self.probs.shape)
        lift = np.exp(2.5)  # per byte, so that products of many small probabilities stay in range
        for block in _blocks(size):
            n, prefix = size[block], _prefix_hashes([raw[k] for k in block])
            alpha = np.zeros((len(block), prefix.shape[1], langs))
            alpha[:, 0] = 1.0
            hits = []
            for j in range(1, prefix.shape[1]):
                row, length, piece = self._hits(prefix, np.flatnonzero(n >= j), j)
                p = self.probs[piece] * (lift**length)[:, None]
                hits.append((row, j - length, piece, p))
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    alpha[row[first], j] = np.add.reduceat(alpha[row, j - length] * p, first, axis=0)
            whole = alpha[np.arange(len(block)), n]
            share = np.where(whole > 0, counts[block] / np.where(whole > 0, whole, 1.0), 0.0)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(block)), n] = 1.0
            for j in range(prefix.shape[1] - 1, 0, -1):
                row, i, piece, p = hits[j - 1]
                if len(row):
                    ends = p * beta[row, j]
                    beta[row, i] += ends  # (row, i) occurs once for each j
                    gamma = alpha[row, i] * ends * share[row]
                    for k in range(langs):
                        total[:, k] += np.bincount(piece, gamma[:, k], len(total))
        return np.nan_to_num(total, posinf=0.0)


def _long_words(parts: list[list[str]], least: int) -> bool:
    """Whether at least ``least`` words have two letters or more."""
    n = 0
    for p in parts:
        for w in p:
            if len(w) > 1:
                n += 1
                if n >= least:
                    return True
    return n >= least


def _bytes_of(word: str) -> bytes:
    return (" " + word).encode("utf-8", "replace")


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _power_table() -> np.ndarray:
    return np.cumprod(np.full(4096, _BASE, np.uint64), dtype=np.uint64)


def _POWERS(length: np.ndarray) -> np.ndarray:
    return _power_table()[length - 1]


def _prefix_hashes(raw: list[bytes]) -> np.ndarray:
    """(strings, bytes + 1): hash of each prefix."""
    width = max(map(len, raw))
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width).astype(np.uint64) + np.uint64(1)
    out = np.zeros((len(raw), width + 1), np.uint64)
    for j in range(width):
        out[:, j + 1] = out[:, j] * _BASE + m[:, j]
    return out


def _hashes(pieces: list[bytes]) -> np.ndarray:
    size = np.array([len(p) for p in pieces], np.int64)
    out = np.zeros(len(pieces), np.uint64)
    for block in _blocks(size):
        out[block] = _prefix_hashes([pieces[k] for k in block])[np.arange(len(block)), size[block]] * _MIX + size[block].astype(np.uint64)
    return out


def _blocks(size: np.ndarray, cells: int = 120_000) -> Iterator[np.ndarray]:
    """Indices of strings of like length, few enough for a matrix."""
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        least = size[order[a]]
        z = int(np.searchsorted(size[order], max(least + 2, least * 5 // 4), side="right"))
        z = max(a + 1, min(z, a + cells // max(1, int(size[order[z - 1]]))))
        yield order[a:z]
        a = z


def _viterbi(rows: list[list[float]]) -> list[int]:
    """The best language of each sentence, a change costing ``SWITCH``."""
    best, back, langs = rows[0], [], range(len(rows[0]))
    for s in rows[1:]:
        k = max(langs, key=best.__getitem__)
        bar = best[k] - SWITCH
        back.append([i if best[i] >= bar else k for i in langs])
        best = [max(x, bar) + y for x, y in zip(best, s)]
    path = [max(langs, key=best.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def _variants(word: str) -> set[str]:
    """The word without accents, and Cyrillic in Latin letters by two customs."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return {bare, *("".join(table.get(c, c) for c in word) for table in (LATIN, LATIN_RU))} - {word}


def _maximise(total: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Mixture of a language's own estimate, the mean over languages and an equal share for every piece, so that no word is impossible in a language."""
    own = total / np.maximum(total.sum(0), 1e-9)
    return 0.975 * own + 0.005 * own.mean(1, keepdims=True) + 0.02 / len(pieces)


def learn(samples: list[tuple[str, list[list[str]]]], pieces: frozenset[bytes], rounds: int = 2, langs: tuple[str, ...] | None = None, seed: int = 7) -> PieceModel:
    """Model from (label, sentences) of texts whose labels are mostly right.

    A fifth of the texts takes no part in the counts; on their sentences the
    temperature of the confidence and the margin to ``other`` are set.
    """
    samples = [(lang, [p for p in parts if p]) for lang, parts in samples]
    langs = langs or tuple(sorted({lang for lang, _ in samples})) or ("und",)
    every = sorted(pieces)
    at = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    kept_out = rng.random(len(samples)) < (0.2 if len(samples) >= 100 else 0.0)
    texts = [x for x, out in zip(samples, kept_out) if not out and x[0] in at]
    labelled = [(at[lang], p) for lang, parts in texts for p in parts]
    model = PieceModel(langs, every, np.full((len(every), len(langs)), 1.0 / len(every)))
    for r in range(rounds + 1):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
        for k, words in labelled:
            for w in words:
                counts[w][k] += 1
        counts = {w: c for w, c in counts.items() if c.sum() >= 2}
        weighted: dict[str, np.ndarray] = {w: c.copy() for w, c in counts.items()}
        for w, c in counts.items():
            for v in _variants(w):
                weighted[v] = weighted.get(v, 0.0) + 0.05 * c
        total = model.expect(list(weighted), np.array(list(weighted.values())).reshape(-1, len(langs)))
        model = PieceModel(langs, model.pieces, _maximise(total, model.pieces))
        if r < rounds:  # label the sentences again
            long = [p for _, parts in texts for p in parts if len(p) > 2]
            labelled = list(zip(model.sentences(long).argmax(1).tolist(), long))
    held = [(at[lang], p) for (lang, parts), out in zip(samples, kept_out) if lang in at and (out or not kept_out.any()) for p in parts]
    return _finish(model, held, rng)


def _finish(model: PieceModel, held: list[tuple[int, list[str]]], rng: np.random.Generator) -> PieceModel:
    """Add the outcome ``other`` and set the temperature and the margin on sentences kept out of the counts.

    ``other`` gives every piece of the vocabulary the same probability. The
    margin, in nats a word, is what nearly all sentences of known languages have
    over it. The temperature is that under which fragments of a few words, cut
    out of sentences whose label and language agree, are most likely to be told
    the language of the whole sentence.
    """
    langs = len(model.langs)
    plain = np.full((len(model.pieces), 1), 1.0 / len(model.pieces))
    full = PieceModel(model.langs, model.pieces, np.concatenate([model.probs, plain], axis=1))
    whole = [p for _, p in held if len(p) >= OTHER_WORDS]
    if whole:
        s = full.sentences(whole)
        lead = (s[:, :langs].max(1) - s[:, -1]) / np.array([len(p) for p in whole])
        full.margin = float(min(np.quantile(lead, 0.002) - 0.5, MARGIN))
        full.usual = float(max(np.quantile(lead, 0.01), 0.5))
        agreed = [(int(k), p) for (k, p), row in zip([x for x in held if len(x[1]) >= OTHER_WORDS], s) if int(row[:langs].argmax()) == k]
        pieces_, truth = [], []
        for k, p in agreed:
            n = int(rng.integers(1, 4))
            a = int(rng.integers(0, len(p) - n + 1))
            pieces_.append(p[a : a + n])
            truth.append(k)
        if pieces_:
            known = full.sentences(pieces_)[:, :langs]
            loss = lambda t: float(np.mean(np.log(np.exp(np.clip((known - known[np.arange(len(truth)), truth][:, None]) / t, -60, 60)).sum(1))))
            full.temperature = min((1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0), key=loss)
    return full


def fit(
    labelled: DataFrame, *, lang: str = "lang", text: str = "text", per_label: int = 1200, per_text: int = 64, least_share: float = 0.002, path: str | None = None
) -> PieceModel:
    """Learn from a bounded sample of labelled rows: about ``per_label`` of each label, chosen by a hash of the text.

    Languages are those of the labels present that have at least ``least_share``
    of the labelled rows. The sentences of the chosen texts, of a text at most
    ``per_text`` spread over its length, are all that reaches the driver. Given
    names are learnt from all rows, so that persons count for no language.
    """
    given = pii.learn_given(labelled, text)
    rows = labelled.select(label_of(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & (F.length("t") > 20))
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(200).collect()}
    sizes = {k: n for k, n in sizes.items() if n >= least_share * sum(sizes.values())}
    share = F.create_map(*(F.lit(x) for k, n in (sizes or {"en": 1}).items() for x in (k, min(1.0, per_label / n))))
    chosen = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.try_element_at(share, F.col("l")) * 1_000_000)

    @F.pandas_udf("array<array<string>>")
    def cut(s: pd.Series) -> pd.Series:
        def some(t: str) -> list[list[str]]:
            parts = [p for p in sentences(t, given) if p]
            return [parts[int(k)] for k in np.linspace(0, len(parts) - 1, per_text)] if len(parts) > per_text else parts

        return s.map(some)

    sample = sorted((r.l, [list(p) for p in r.s]) for r in chosen.select("l", cut("t").alias("s")).collect())
    model = learn(sample, load_pieces(path or vocabulary_path()), langs=tuple(sizes) or None)
    model.given = given
    return model


def find_stretches(df: DataFrame, text: str, model: PieceModel) -> DataFrame:
    """``df`` with ``stretches``: an array of (seg, lang, confidence)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<seg:bigint,lang:string,confidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for s in batches:
            texts = s.tolist()
            out = [x for k in range(0, len(texts), 2000) for x in m.stretches(texts[k : k + 2000])]  # bounds the memory of long texts
            yield pd.Series([[{"seg": k + 1, "lang": lang, "confidence": c} for k, (lang, c) in enumerate(x)] for x in out])

    return df.withColumn("stretches", run(text))


def wrong_or_mixed(found: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows whose label is missing or another than the text's, or whose text has several languages."""
    label = label_of(lang)
    several = F.size("stretches") > 1
    differs = F.coalesce(label != F.col("stretches")[0]["lang"], F.lit(True))
    return found.where((F.size("stretches") > 0) & (several | differs))
