"""Personal information in free text: anchors found in one pass, local parsers around each.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs and
their spelled forms, schemes, digits and plus signs, street words, words that
introduce a person, given names, initials. Each anchor is expanded by a small
deterministic parser that finds the item's boundaries and validates it (digit
grouping, check letters, label syntax). An item that overlaps one already taken
falls away, and what stands inside a link is no item.

There is no list of names. Given names are learnt from the corpus: words that
stand before an initial and a surname, and words that stand before several of
the surnames so found. Besides, a person is two or three capitalised words that
a word for meeting, naming or addressing someone introduces or follows.

Defined cases: a null or empty text has no item and is redacted to itself;
positions count code points from 1; the same text always gives the same items,
so repeated rows give them once after ``distinct``; texts of any length are
processed whole, at a cost linear in their length; other columns stay untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora import workspace

#: Words that begin sentences or follow a full stop and are no surname (fixed values).
OPENERS = frozenset(
    "a an the at as in on is it if he she we i you this that there these what why who how can do does did please thanks thank "
    "meanwhile again yesterday surprisingly later by for once most between score build ticket position version remember send "
    "deliver ask passport regards my your our no not and or but so to from with of der die das ein eine ich wir sie es was wann "
    "warum wer wie zum im gestern heute danach manchmal bitte kannst weißt le la les un une je tu il elle on nous vous que "
    "pourquoi quand hier merci dans de à el los las una yo qué por ayer hoy gracias en según о в на я мы ты он она это что "
    "почему когда вчера сегодня спасибо а и но не как o os as um uma eu nós ontem hoje é у з я ми ти вчора сьогодні чому".split()
)

#: Words that introduce a person, and words that tell what one did (fixed values).
INTRODUCING = (
    "met|asked|told|spoke with|talked to|talked with|my name is|called by|signed by|written by|mr|mrs|ms|dr|dear|attention|attn|regards,|sincerely,|contact|"
    "herr|frau|ich heiße|grüßen|señor|señora|me llamo|hablé con|saludo,|monsieur|madame|je m'appelle|cordialement,|chez|меня зовут|господин|госпожа|получатель|уважением,|"
    "мене звати|пан|пані|senhor|senhora|me chamo|falei com"
).split("|")
ACTING = "met|said|says|asked|told|wrote|writes|called|replied|answered|thinks|hat gesagt|sagte|schrieb|dijo|escribió|llamó|a dit|écrit|сказал|сказала|написал|написала|disse|escreveu".split("|")

_SEP = r"[ .\-/]"
_NOT_BEFORE = r"(?<![\w#@])(?<![\w][.\-/_:])"

#: (kind, parser) in order of precedence; each is matched at a digit, plus or bracket anchor.
_NUMBERS = [
    ("phone", r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){2,6}(?<=\d)(?!\w)"),
    ("phone", r"00\d{2}(?:[ .\-/]?\(?\d{1,9}\)?){1,6}(?<=\d)(?!\w)"),
    ("id_number", r"[1278] \d\d (?:0[1-9]|1[0-2]|[2-9]\d) \d[\dAB] \d{3} \d{3}(?: \d\d)?(?![\w])"),
    ("id_number", r"\d{3}([ \-])\d\d\1\d{4}(?![\w])"),
    ("id_number", r"\d\d ?\d\d(?: ?№ ?| |-)\d{6}(?![\w\-])"),
    ("dni", r"(?:\d{8}|\d\d\.\d{3}\.\d{3})-?[A-Za-z](?![\w])"),
    ("phone", r"(?:1[ .\-])?\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)"),
    ("phone", r"(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}(?!\w)"),
    ("phone", r"[78] ?\(\d{3,4}\) ?\d{2,3}[ \-]?\d\d[ \-]?\d\d(?!\w)"),
    ("phone", r"8[ \-]?\d{3}[ \-]?\d{3}[ \-]?\d\d[ \-]?\d\d(?!\w)"),
    ("phone", r"0\d{2,4} \d{3,4} \d{4}(?!\w)"),
    ("phone", r"\(0\d{1,4}\) ?\d{3,8}(?:[ \-]\d{2,5})*(?!\w)"),
    ("phone", r"0\d{1,4} ?/ ?\d{3,8}(?:[ \-]\d{2,5})*(?!\w)"),
    ("phone", r"0\d(?:([ .\-])\d\d)(?:\1\d\d){3}(?!\w)"),
    ("phone", r"[6789]\d\d([ \-])\d{3}\1\d{3}(?!\w)"),
]
_PLAIN9 = re.compile(r"\d{9}(?![\w\-.]\d|\w)")
_TEL_CUE = re.compile(r"(?i)(?:tel|phone|call|llama al|tel[ée]fono|appelez|rufen|rückruf|звоните|телефон|тел)\W{0,3}(?:es|is|sie|le|al)?\W{0,3}$")
_ALNUM_ID = [
    re.compile(r"(?i)[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)"),
    re.compile(r"(?i)[LMNPRTVWXYCFGHJK](?=(?:\w*\d){4})[0-9CFGHJKLMNPRTVWXYZ]{8}(?!\w)"),
]
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_EN_STREET = "Street|Road|Lane|Avenue|Close|Court|Drive|Way|Place|Square|Terrace|Crescent|Gardens|Hill|Row|Walk|Boulevard"
_WORD = r"[A-ZÀ-ÞЀ-Я][\w’'-]*"
_EN_ADDR = rf"\d{{1,5}}[A-Za-z]?,? (?:{_WORD} ){{1,3}}(?:{_EN_STREET})(?!\w)"
_FR_ADDR = r"\d{1,4}(?: ?bis| ?ter|[a-z])?,? (?:rue|quai|chemin|place|avenue|boulevard|allée|impasse|cours|square)(?: (?:du|des|de la|de l’|de l'|de))? ?[A-ZÀ-Þ]\w+"
_DE_ADDR = rf"(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|gasse|platz|weg|allee|ring|damm|ufer|STRASSE|STRAßE|GASSE|PLATZ|WEG|ALLEE)|(?:Am|An der|Auf dem|Zum|Zur|AM)(?: {_WORD}){{1,2}}) \d{{1,4}} ?[a-z]?(?!\w)"
_ES_ADDR = rf"(?:Calle|Avenida|Paseo|Plaza|Camino|Carretera|Ronda|Travesía|CALLE|AVENIDA|PASEO|PLAZA|CAMINO)(?: (?:de las|de los|de la|del|de|DE LOS|DEL|DE))?(?: {_WORD}){{1,2}},? \d{{1,4}}(?!\w)"
_RU_ADDR = rf"(?:ул\.|улица|пр-т|проспект|пер\.|переулок|наб\.|набережная|пл\.|площадь|бул\.|бульвар|шоссе|УЛ\.|УЛИЦА|ПР-Т|ПЕР\.|НАБ\.) ?(?:{_WORD})(?: {_WORD})?,? (?:д\. ?|Д\. ?)?\d{{1,4}}"

_STREET_CUES = (
    "straße strasse gasse platz weg allee ring damm ufer calle avenida paseo plaza camino carretera ronda ул. улица пр-т проспект "
    "пер. переулок наб. набережная площадь бульвар шоссе"
).split()

KINDS = ("email", "phone", "id_number", "address", "person")


_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽЀ-Я]"
_NAME = _CAPITAL + r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"


class _Rules:
    """Parsers for one letter case: names and streets are capitalised, or the whole text is in one case."""

    def __init__(self, any_case: bool):
        flag = re.IGNORECASE if any_case else 0
        self.any_case = any_case
        self.numbers = [(k, re.compile(p)) for k, p in _NUMBERS]
        self.digit_addr = [re.compile(_EN_ADDR, flag), re.compile(_FR_ADDR, flag)]
        self.word_addr = [re.compile(p, flag) for p in (_DE_ADDR, _ES_ADDR, _RU_ADDR)]
        word = r"[^\W\d_][\w’'-]+" if any_case else _CAPITAL + r"[\w’'-]+"
        letter = r"[^\W\d_]" if any_case else _CAPITAL
        self.after_given = re.compile(rf" (?:({letter})\.(?: ({word}))?|({word}))")
        self.word = re.compile(word)
        self.initial = re.compile(rf"{letter}\. (?:{letter}\. )?({word})")


_STREET_ANCHORS = (*_STREET_CUES, "am ", "an der ", "auf dem ", "zum ", "zur ")
_FULL_NAME = re.compile(rf"{_NAME}(?: {_NAME}){{1,2}}(?![\w@-])")
_ACTED = re.compile(r" (?:" + "|".join(ACTING) + r")\b")


@lru_cache(maxsize=4)
def _machine(given: frozenset[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors = [("@", "at"), (" at ", "at"), ("(at)", "at"), ("[at]", "at"), ("://", "link"), ("mailto:", "scheme"), ("tel:", "scheme")]
    anchors += [(d, "digit") for d in "0123456789+("] + [(s, "street") for s in _STREET_ANCHORS] + [(". ", "initial")]
    kinds: dict[str, set[str]] = {}
    for w, kind in anchors + [(w + " ", "cue") for w in INTRODUCING] + [(w + "\n", "cue") for w in INTRODUCING if w[-1] in ",n"] + [(w + ": ", "cue") for w in ("name", "contact", "attention")] + [(" " + w, "act") for w in ACTING]:
        kinds.setdefault(w, set()).add(kind)
    for g in given:
        kinds.setdefault(g.lower(), set()).add("given")
    for w, k in kinds.items():
        a.add_word(w, (tuple(sorted(k)), len(w)))
    a.make_automaton()
    return a, _Rules(False), _Rules(True)


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_DOMAIN = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}")
_SPELLED = re.compile(r"(?i)(?:[^\W_]|-)+(?:(?: ?[\[(]dot[\])] ?| dot |\.)(?:[^\W_]|-)+)+")
_LINK = re.compile(r"://[^\s<>\"'`]*")


def _email(text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
    """Expand the at-sign at i:j to a local part and a domain with at least two labels."""
    start = i
    if text[i] != "@" and i and text[i - 1] == " ":
        start = i - 1
    begin = start
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.%+-"):
        begin -= 1
    while begin < start and text[begin] in ".-+%":
        begin += 1
    if begin == start:
        return None
    rest = j + 1 if text[j : j + 1] == " " else j
    d = (_DOMAIN if text[i] == "@" else _SPELLED).match(text, rest)
    if not d or (low[i:j] == " at " and " dot " not in d.group().lower()):
        return None
    return begin, d.end()


class _Taken:
    """Spans that do not overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[str, int, int]] = []

    def _clear(self, a: int, b: int) -> int:
        k = bisect_left(self.starts, b)
        return k if not k or self.spans[k - 1][2] <= a else -1

    def add(self, kind: str, a: int, b: int) -> bool:
        k = self._clear(a, b)
        if k >= 0:
            self.starts.insert(k, a)
            self.spans.insert(k, (kind, a, b))
        return k >= 0

    def holds(self, i: int) -> bool:
        return self._clear(i, i + 1) < 0


def find_items(text: str | None, given: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """The items of a text as (kind, start, end), in order, without overlap; offsets are code points from 0."""
    if not text:
        return []
    machine, strict, loose = _machine(given)
    low = _fold(text)
    rules = loose if text == low or text.upper() == text else strict
    at: dict[str, list[tuple[int, int]]] = {"at": [], "digit": [], "street": [], "link": [], "scheme": [], "cue": [], "act": [], "given": [], "initial": []}
    for end, (kinds, n) in machine.iter(low):
        for kind in kinds:
            at[kind].append((end + 1 - n, end + 1))
    taken = _Taken()
    take = taken.add
    for i, _ in at["link"]:
        m = _LINK.match(text, i)
        if text[i - 1 : i].isalpha() and "@" not in m.group():
            take("link", i, m.end())
    for i, j in at["at"]:
        if span := _email(text, low, i, j):
            take("email", *span)
    for i, _ in at["street"]:
        a = i
        while a and (text[a - 1].isalpha() or text[a - 1] == "-"):
            a -= 1
        for p in rules.word_addr:
            if m := p.match(text, a):
                take("address", a, m.end())
                break
    seen = -1
    for i, _ in at["digit"]:
        if i < seen:
            continue
        run = i and (text[i - 1].isdigit())
        if not run and not (i and (text[i - 1].isalpha() or text[i - 1] in "_#@+")) and text[i].isdigit():
            for p in rules.digit_addr:
                if m := p.match(text, i):
                    words = {w.lower() for w in re.findall(r"[^\W\d_]+", m.group())}
                    if not rules.any_case or not words & OPENERS - {"de", "la", "le"}:
                        take("address", i, m.end())
                        seen = i + 1
                    break
    for i, _ in at["digit"]:
        if not taken.holds(i):
            _number(text, i, rules, take, any(low.startswith(x, i - len(x)) for x in ("tel:", "tel:+")) if i >= 4 else False)
    _people(text, low, at, rules, taken)
    return [x for x in taken.spans if x[0] != "link"]


def _number(text: str, i: int, rules: _Rules, take, after_scheme: bool) -> None:
    """Expand the digit, plus sign or bracket at i to a phone or identity number."""
    if not after_scheme:
        if i and (text[i - 1].isdigit() or text[i - 1] in "_#@" or (text[i - 1] == "+" and text[i] != "+")):
            return
        if text[i - 1 : i].isalpha():
            for back in range(1, 5):  # two letters and a blank, or one letter, before the digits
                if i - back >= 0 and not text[i - back - 1 : i - back].isalnum():
                    for p in _ALNUM_ID:
                        if m := p.match(text, i - back):
                            take("id_number", i - back, m.end())
                            break
                    break
            return
        if i >= 3 and text[i - 1] == " " and text[i - 3 : i - 1].isalpha() and not text[i - 4 : i - 3].isalnum():
            if m := _ALNUM_ID[0].match(text, i - 3):
                take("id_number", i - 3, m.end())
                return
        if i >= 2 and text[i - 1] in ".-/:" and text[i - 2].isalnum():
            return
    for kind, p in rules.numbers:
        m = p.match(text, i)
        if not m or (m.end() < len(text) - 1 and text[m.end()] in "-./:" and text[m.end() + 1].isdigit()):
            continue
        digits = re.sub(r"\D", "", m.group())
        if kind == "dni":
            if _DNI_LETTERS[int(digits) % 23] != m.group()[-1].upper():
                continue
            kind = "id_number"
        elif kind == "phone" and not 8 <= len(digits) <= 15:
            continue
        take(kind, i, m.end())
        return
    if m := _PLAIN9.match(text, i):
        take("phone" if after_scheme or _TEL_CUE.search(text, max(0, i - 32), i) else "id_number", i, m.end())


def _people(text: str, low: str, at: dict[str, list[tuple[int, int]]], rules: _Rules, taken: _Taken) -> None:
    """Persons at initials and given names, then those that only their shape and the words beside them tell."""
    take = taken.add
    for (i, j), kind in sorted([(x, "given") for x in at["given"]] + [(x, "initial") for x in at["initial"]], key=lambda x: x[0][1]):
        if kind == "initial":
            a = i - 1
            if a < 0 or not text[a].isalpha() or (a and (text[a - 1].isalnum() or text[a - 1] in "._-'’ºª")):
                continue
            m = rules.initial.match(text, a)
            if not m or m.group(1).lower() in OPENERS or (text[a].islower() and not rules.any_case):
                continue
            if text[max(0, a - 2) : a] in ("º ", "ª "):  # a door of a Spanish address
                continue
            z = a
            while z and text[z - 1].isspace():
                z -= 1
            if z and text[z - 1] == "." and (z < 3 or text[z - 3] in " \n"):
                continue
            take("person", a, m.end())
            continue
        if (i and (text[i - 1].isalnum() or text[i - 1] in "_@.+-")) or text[j : j + 1].isalnum() or text[j : j + 1] in ("@", "_"):
            continue
        if not rules.any_case and not text[i].isupper():
            continue
        m = rules.after_given.match(text, j)
        b = i
        if text[i - 2 : i] == ", ":
            b = i - 2
            while b and (text[b - 1].isalnum() or text[b - 1] in "_’'-"):
                b -= 1
            w = rules.word.match(text, b, i - 2)
            b = b if w and w.end() == i - 2 and w.group().lower() not in OPENERS and not (m and m.group(1)) else i
        if b < i:
            take("person", b, j)
        elif m and m.group(1):
            take("person", i, m.end() if m.group(2) and m.group(2).lower() not in OPENERS else m.end(1) + 1)
        elif m and m.group(3).lower() not in OPENERS:
            take("person", i, m.end())
    if rules.any_case:
        return
    ends = set()

    def named(a: int) -> bool:
        m = _FULL_NAME.match(text, a)
        while m and not taken.holds(a) and any(w.lower() in OPENERS for w in m.group().split()):
            return False
        if m and take("person", a, m.end()):
            ends.add(m.end())
            return True
        return False

    for i, j in at["cue"]:
        if not (i and text[i - 1].isalnum()) and named(j):
            a = max(ends)
            while True:  # a list of persons goes on
                m = _AND.match(text, a)
                if not m or not named(m.end()):
                    break
                a = max(ends)
    for i, j in at["act"]:
        if text[j : j + 1].isalpha():
            continue
        a = i
        while a and (text[a - 1].isalpha() or text[a - 1] in "-’' "):
            a -= 1
            if text[a] == " " and not text[a + 1 : a + 2].isupper():
                a += 1
                break
        m = _FULL_NAME.match(text, a) if text[a : a + 1].isupper() else None
        if m and m.end() == i:
            named(a)


_AND = re.compile(r",? (?:and|und|y|et|и|та|e) |, ")

# --- given names, learnt from the corpus

_TRIPLE = re.compile(rf"(?<![\w@.+-])({_NAME}) {_CAPITAL}\. ({_NAME})")
_LONE_INITIAL = re.compile(rf"(?<![\w@.+'’ºª-] )(?<![\w@.+'’ºª-]){_CAPITAL}\. ({_NAME})")
_RUN = re.compile(rf"(?<![\w@.+-]){_NAME}(?: {_NAME})+")


def learn_given(df: DataFrame, text: str, *, surnames: int = 2, most: int = 50_000) -> frozenset[str]:
    """Given names of the texts, in lower case: words that stand before an initial and at least ``surnames`` different
    surnames, or before as many of the surnames known from initials. At most ``most``, those of the most surnames first.

    Counted over all rows; what is collected is the names alone. Words that begin sentences are none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            for t in b[text]:
                if ". " in t:
                    found.update(("t", g, s) for g, s in _TRIPLE.findall(t))
                    found.update(("i", "Xx", s) for s in _LONE_INITIAL.findall(t))
                for run_ in _RUN.findall(t):
                    words = run_.split(" ")
                    found.update(("p", g, s) for g, s in zip(words, words[1:]))
            # a capital and small letters: words of texts in capitals are no names
            rows = [(k, g.lower(), s.lower()) for k, g, s in found if g[1:].islower() and s[1:].islower()]
            yield pd.DataFrame([r for r in rows if r[1] not in OPENERS and r[2] not in OPENERS], columns=["kind", "given", "surname"])

    rows = df.where(F.col(text).isNotNull()).select(text).mapInPandas(run, "kind string, given string, surname string").distinct()
    rows = workspace.materialise(rows, "names")
    sure = rows.where("kind <> 'p'").select("surname").distinct()
    pairs = rows.where("kind = 'p'").join(sure, "surname", "left_semi").unionByName(rows.where("kind = 't'"))
    names = pairs.groupBy("given").agg(F.countDistinct("surname").alias("n")).where((F.col("n") >= surnames) & (F.length("given") > 1))
    return frozenset(r.given for r in names.orderBy(F.desc("n"), "given").limit(most).collect())


def redact_text(text: str | None, items: list[tuple[str, int, int]]) -> str | None:
    """The text with a typed placeholder for each item, otherwise unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in items:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, text: str, keys: list[str], given: frozenset[str] = frozenset()) -> DataFrame:
    """One row per item: the keys, ``kind``, ``start_pos`` (code points from 1) and ``length``."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*k, kind, a + 1, z - a) for *k, t in b.itertuples(index=False) for kind, a, z in find_items(t, given)]
            yield pd.DataFrame(found, columns=schema.names)

    return df.where(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, schema)


def redact(df: DataFrame, text: str, given: frozenset[str] = frozenset()) -> DataFrame:
    """``df`` with the column ``text`` redacted."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact_text(t, find_items(t, given)), na_action="ignore")

    return df.withColumn(text, clean(text))
