"""Abusive, hateful and sexual language, by FTRL-proximal logistic regression.

A document is scored by its worst sentence. A sentence's features are hashed
word n-grams (one to three words) and skip-grams (one and two words left out),
after spellings meant to hide words are undone: letters of other scripts,
digits for letters, drawn-out, spaced or masked letters. One set of per-
coordinate rates serves three outputs; L1 keeps the weights few, so that they
are sent to the executors as pairs of index and weight.

The ratings say that a document is toxic, not where or of what kind. Where is
learnt first: all sentences of toxic documents are weak examples against those
of harmless ones, then only the worst of each document are examples. Of what
kind is begun with a few general stems that name the kinds and carried on by
what sentences have in common with the named ones. Sentences of harmless
documents are counter-examples, those with such stems included.
The fit uses a bounded sample: at most ``max_rated`` rated documents, chosen by
a hash of their ids. Scores and rates cover every row.

Defined cases: null and empty texts score 0 in every kind; raters are averaged,
ratings without a document, or null, are left out; without positive ratings
nothing is found; texts are scored whole; repeated rows score alike; null
sources make a group of their own in the rates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.markup import without_accents, without_tags

KINDS = ("abusive", "hateful", "sexual")

#: Stems of a small general vocabulary that names the kinds (fixed values). What is toxic comes from the ratings alone.
PRIOR = {
    "abusive": (
        "idiot moron stupid dumb imbecil loser worthless pathetic bastard asshole bitch scum shut kill "
        "dumm trottel arschloch schlampe abschaum maul umbring "
        "идиот кретин дурак дура тупой тупая тупиц придур урод ублюд заткн сдохн убью убить ненавижу ідіот дурень тупий "
        "estúpid tonto tonta payas basura cállate matar muérete crétin abruti stupide connard salaud ordure tuer crève burro lixo cala"
    ),
    "hateful": (
        "vermin parasit subhuman inferior immigrant foreigner deport race animals rats disease crimin thieves "
        "ungeziefer untermensch ausländer rasse ratten abschieb verbrech "
        "паразит недочелов чужак мигрант раса крысы животн нелюд преступ тварин щури злочин "
        "parásit plaga raza ratas inmigrante extranjer vermine étranger nuisible bêtes praga raça imigrante estrangeir"
    ),
    "sexual": (
        "sex naked nude porn erotic orgasm breast horny lust undress fondl thigh penis vagina "
        "nackt erotisch brüste "
        "секс голая голые голой порно эротик оргазм грудь гола оголен "
        "desnud pechos erótic nus seins érotique nudez pelad seios"
    ),
}

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)\]}]*\s+|[\n\r\t]+|\\[nrt]|\"\s*[:,}\]]+\s*\"?|[{\[]+\s*\"")
_SPACED = re.compile(r"(?<!\w)(?:\w ){2,}\w(?!\w)")
_TOKEN = re.compile(r"[^\W_$@*]*[\w$@*][\w$@*’']*")
_REPEAT = re.compile(r"(.)\1+")
_DIGITS = str.maketrans("01345@$|", "oieasasl")
_CYR, _LAT = "аеорсхуікмтнвзё", "aeopcxyikmthbze"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYR, _LAT), str.maketrans("aeopcxyikmt", "аеорсхуікмт")


def _plain(token: str) -> str:
    if "*" in token:
        return "*" if token.strip("*") else ""
    if not token.isalpha():
        if not any(c.isalpha() for c in token):
            return "#"
        token = token.translate(_DIGITS)
        token = "".join(c for c in token if c.isalpha())
    if not token.isascii():
        cyr = sum("а" <= c <= "я" or c in "ёіїєґ" for c in token)
        if cyr and any("a" <= c <= "z" for c in token):  # two scripts: the letters that have no double decide
            own_cyr = sum(("а" <= c <= "я" or c in "їєґ") and c not in _CYR for c in token)
            own_lat = sum("a" <= c <= "z" and c not in _LAT for c in token)
            token = token.translate(_TO_CYRILLIC if own_cyr > own_lat or (own_cyr == own_lat and 2 * cyr > len(token)) else _TO_LATIN)
        token = without_accents(token)
    return _REPEAT.sub(r"\1", token)


class _Words:
    """Tokens of sentences, with the plain form of each token kept."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def sentences(self, text: str | None, longest: int = 40) -> list[list[str]]:
        if not text:
            return []
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", without_tags(text, "\n"))).lower()
        out = []
        if len(self.known) > 300_000:
            self.known.clear()
        for s in _SPLIT.split(text):
            if not s:
                continue
            if " " in s:
                s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s)
            words = []
            for t in _TOKEN.findall(s):
                p = self.known.get(t)
                if p is None:
                    p = self.known[t] = _plain(t)
                if p:
                    words.append(p)
            for k in range(0, max(1, len(words) - 8), longest):  # a run without stops is read in windows
                if words[k : k + longest + 8]:
                    out.append(words[k : k + longest + 8])
        return out


def _prior() -> list[re.Pattern]:
    """For each kind, the words that begin with a stem of it, or are it where it is short."""
    stem = lambda w: w if len(w) > 4 or (len(w) == 4 and not w.isascii()) else w + r"(?: |$)"
    return [re.compile(r"(?:^| )(?:" + "|".join(sorted({stem(_plain(w)) for w in PRIOR[k].split()})) + ")") for k in KINDS]


class Features:
    """Hashed n-grams and skip-grams of many sentences at once."""

    def __init__(self, bits: int):
        self.bits, self.known = bits, {}

    def of(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, sentence) pairs, ordered by sentence within each sort of feature."""
        import xxhash

        flat, known = [], self.known
        if len(known) > 300_000:
            known.clear()
        for s in sentences:
            for w in s:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
        h = np.array(flat, np.uint64)
        own = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        feats, rows = [h], [own]
        a, b, c, d = (np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        for gap, salt in ((1, b), (2, c), (3, d)):
            if len(h) > gap:
                same = own[gap:] == own[:-gap]
                feats.append(((h[:-gap] * a) ^ (h[gap:] * salt))[same])
                rows.append(own[gap:][same])
        if len(h) > 2:
            same = own[2:] == own[:-2]
            feats.append((((h[:-2] * a) ^ (h[1:-1] * b)) * c ^ (h[2:] * d))[same])
            rows.append(own[2:][same])
        x = np.concatenate(feats)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal logistic regression with several outputs over one feature space."""

    def __init__(self, bits: int = 20, outputs: int = 3, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.4, l2: float = 0.5):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z = np.zeros((1 << bits, outputs))
        self.n = np.zeros((1 << bits, outputs))
        self.bias = np.full(outputs, -3.0)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, feats: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        z, n = self.z[feats], self.n[feats]
        w = self._weights(z, n)
        p = 1.0 / (1.0 + np.exp(-np.clip(self.bias + w.sum(0), -30, 30)))
        g = (p - target) * weight
        g2 = g * g
        self.z[feats] = z + g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[feats] = n + g2

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self._weights(self.z, self.n)
        at = np.flatnonzero(np.abs(w).sum(1) > 0)
        return at, w[at].astype(np.float32)


class Model:
    """Sparse weights; scores sentences and documents."""

    def __init__(self, bits: int, at: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.bits, self.at, self.weights, self.bias = bits, at, weights, bias
        self._dense = self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None, "_tools": None}

    def sentences(self, sentences: list[list[str]]) -> np.ndarray:
        """Probability of each kind for each sentence."""
        if self._dense is None:
            self._dense = np.zeros((1 << self.bits, len(self.bias)), np.float32)
            self._dense[self.at] = self.weights
            self._tools = _Words(), Features(self.bits)
        if not sentences:
            return np.zeros((0, len(self.bias)))
        x, row = self._tools[1].of(sentences)
        w = self._dense[x]
        some = np.flatnonzero(w.any(axis=1))
        out = np.stack([np.bincount(row[some], w[some, k], len(sentences)) for k in range(w.shape[1])], axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -30, 30)))

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Greatest probability of each kind over a document's sentences."""
        if self._tools is None:
            self.sentences([])
        parts = [self._tools[0].sentences(t) for t in texts]
        p = self.sentences([s for ps in parts for s in ps])
        out, k = np.zeros((len(texts), len(self.bias))), 0
        for i, ps in enumerate(parts):
            if ps:
                out[i] = p[k : k + len(ps)].max(0)
            k += len(ps)
        return out


def _train(features: Features, examples: list[list[str]], y: np.ndarray, weight: np.ndarray, *, epochs: int, rng: np.random.Generator) -> Model:
    """Fit on positive examples, which come first, and counter-examples, of which the later epochs take those still mistaken and some others."""
    x, row = features.of(examples)
    order = np.argsort(row, kind="stable")
    x, row = x[order], row[order]
    ends = np.searchsorted(row, np.arange(len(examples) + 1))
    ftrl = Ftrl(features.bits, outputs=y.shape[1])
    first = int(y.any(axis=1).sum())
    rest = len(examples) - first
    for epoch in range(epochs):
        some = first + rng.permutation(rest)[: max(4 * first, 5_000)]
        if epoch:
            now = Model(features.bits, *ftrl.sparse(), ftrl.bias).sentences(examples[first:])
            some = np.union1d(some[: len(some) // 4], first + np.flatnonzero(now.max(axis=1) > 0.05))
        for i in rng.permutation(np.concatenate([np.arange(first), some])):
            ftrl.learn(np.unique(x[ends[i] : ends[i + 1]]), y[i], weight[i])
    return Model(features.bits, *ftrl.sparse(), ftrl.bias)


def _culprits(features: Features, suspects: list[list[str]], good: list[list[str]], times: np.ndarray, docs: list[np.ndarray], *, least: int = 2, bar: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Which sentences of the toxic documents make them so: those whose n-grams other toxic documents have and harmless ones have not.

    An n-gram of at least ``least`` other toxic documents speaks by the log of
    its odds; a sentence is one of its document's where its n-grams reach
    ``bar`` and half of the worst sentence's. Beside them: whether most of a
    sentence's n-grams occur in no harmless document.
    """
    held, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    x, row = features.of(suspects)
    pair = np.unique(row << 32 | x)
    x, row = pair & 0xFFFFFFFF, pair >> 32
    starts = np.searchsorted(row, np.arange(len(suspects) + 1))
    size = starts[held + 1] - starts[held]
    at = np.repeat(starts[held] - np.cumsum(size) + size, size) + np.arange(size.sum())
    key = np.unique(x[at] << 32 | np.repeat(owner, size))  # a document counts once
    y, from_ = features.of(good)
    toxic, harmless = np.bincount(key >> 32, minlength=1 << features.bits), np.bincount(y, times[from_], minlength=1 << features.bits)
    ratio = max(1.0, times.sum()) / max(1, len(held))
    odds = np.log(np.maximum(toxic - 0.7, 0.01) * ratio / (harmless + 0.3 * ratio))
    odds = np.where((toxic > least) & (odds > 1.4), np.minimum(odds, 4.0), 0.0)
    worth = np.bincount(row, odds[x], len(suspects))
    worst = np.zeros(len(docs))
    np.maximum.at(worst, owner, worth[held])
    strange = np.bincount(row, harmless[x] == 0, len(suspects)) >= 0.5 * np.bincount(row, minlength=len(suspects))
    return np.unique(held[(worth[held] >= bar) & (worth[held] >= 0.5 * worst[owner])]), strange


def _spread_kinds(features: Features, sentences: list[list[str]], kinds: np.ndarray, margins: tuple[float, ...] = (8.0, 6.0, 4.0, 3.0, 2.0, 1.0)) -> np.ndarray:
    """Kinds carried from named sentences to the others by the n-grams they share, the clearest first."""
    x, row = features.of(sentences)
    pair = np.unique(x << 32 | row)
    x, row = pair >> 32, pair & 0xFFFFFFFF
    _, x = np.unique(x, return_inverse=True)
    kinds = kinds.copy()
    for margin in margins:
        known = kinds.any(axis=1)
        if known.all() or not known.any():
            break
        n = np.stack([np.bincount(x, kinds[row, k], x.max() + 1) for k in range(kinds.shape[1])], axis=1)
        rate = n + 0.3
        speaks = np.where((n.sum(1) > 0)[:, None], np.log(rate / rate.mean(1, keepdims=True)), 0.0)
        vote = np.stack([np.bincount(row, speaks[x, k], len(sentences)) for k in range(kinds.shape[1])], axis=1)
        top = np.sort(vote, axis=1)
        sure = ~known & (top[:, -1] - top[:, -2] >= margin)
        kinds[sure, vote[sure].argmax(axis=1)] = 1.0
    return kinds


def learn(rated: list[tuple[float, str]], *, bits: int = 20, rounds: int = 3, epochs: int = 5, seed: int = 7) -> Model:
    """Model from (mean toxic rating, text) of documents."""
    words, features, prior, rng = _Words(), Features(bits), _prior(), np.random.default_rng(seed)
    counts: dict[str, list] = {}  # sentence: itself, how often in toxic and in harmless documents
    holders: list[list[str]] = []  # sentences of each toxic document
    for toxic, text in rated:
        if toxic > 0.5 or toxic == 0:
            keys = []
            for s in words.sentences(text):
                keys.append(" ".join(s))
                counts.setdefault(keys[-1], [s, 0, 0])[1 if toxic else 2] += 1
            if toxic:
                holders.append(keys)
    # raters err: a sentence is on the side it is found on more often
    bad = {k: i for i, k in enumerate(k for k, (_, x, y) in counts.items() if x > y)}
    suspects = [counts[k][0] for k in bad]
    good = [s for s, x, y in counts.values() if y >= x]
    docs = [np.unique([bad[k] for k in keys if k in bad]) for keys in holders]
    docs = [d for d in docs if len(d)]
    if not docs:
        return Model(bits, np.zeros(0, np.int64), np.zeros((0, len(KINDS)), np.float32), np.full(len(KINDS), -3.0))
    named = np.array([[bool(p.search(k)) for p in prior] for k in bad], bool).reshape(-1, len(KINDS))
    chosen, strange = _culprits(features, suspects, good, np.array([y for _, x, y in counts.values() if y >= x], float), docs)
    # a document without one has those sentences that are named a kind and are like nothing harmless
    covered = np.isin(np.arange(len(suspects)), chosen)
    named_only = [d[named[d].any(axis=1) & strange[d]] for d in docs if not covered[d].any()]
    chosen = np.unique(np.concatenate([chosen, *named_only])).astype(int)
    # of what kind: by name where it has one, then by what it has in common with the named ones
    targets = np.zeros((len(suspects), len(KINDS)))
    targets[chosen] = _spread_kinds(features, [suspects[i] for i in chosen], named[chosen].astype(float))
    model = Model(bits, np.zeros(0, np.int64), np.zeros((0, len(KINDS)), np.float32), np.full(len(KINDS), -3.0))
    for r in range(2):
        if r:  # what the first fit is sure of, in all suspects
            p = model.sentences(suspects) >= 0.5
            targets = np.where(targets.any(axis=1, keepdims=True), targets, p)
        use = targets.any(axis=1)
        examples = [s for s, u in zip(suspects, use) if u] + good
        y = np.concatenate([targets[use], np.zeros((len(good), len(KINDS)))])
        model = _train(features, examples, y, np.where(y.any(axis=1), 3.0, 1.0), epochs=epochs, rng=rng)
    return model


def fit(documents: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", max_rated: int = 20_000) -> Model:
    """Fit on the rated documents, at most about ``max_rated`` of them; no more than these reach the driver."""
    mean = ratings.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg("toxic").alias("toxic"))
    n = mean.count()
    if n > max_rated:
        mean = mean.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max_rated / n * 1_000_000)
    rows = documents.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(mean), key)
    return learn(sorted((r.toxic, r[text]) for r in rows.select("toxic", text).collect()))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``scores``: a struct of one probability for each kind."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("abusive double, hateful double, sexual double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.tolist()
            p = [held.value.documents(texts[k : k + 500]) for k in range(0, len(texts), 500)]
            yield pd.DataFrame(np.concatenate(p) if p else np.zeros((0, 3)), columns=list(KINDS))

    return documents.withColumn("scores", run(text))


def flagged(scored: DataFrame, key: str, threshold: float = 0.33) -> DataFrame:
    """(key, category) for each kind a document reaches the threshold in."""
    kinds = F.array(*(F.when(F.col(f"scores.{k}") >= threshold, F.lit(k)) for k in KINDS))
    return scored.select(key, F.explode(F.array_compact(kinds)).alias("category"))


def rates(scored: DataFrame, source: str = "source", threshold: float = 0.33) -> DataFrame:
    """Documents of each source and the shares of those that reach the threshold; null sources are a group."""
    share = lambda k: F.round(F.avg((F.col(f"scores.{k}") >= threshold).cast("double")), 6).alias(f"{k}_rate")
    return scored.groupBy(source).agg(F.count("*").alias("documents"), *map(share, KINDS))
