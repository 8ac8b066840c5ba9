"""Rules over questions and contexts: intents, strategies, parts, tokens, phases, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import text as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Intents of questions (fixed values): patterns in order of precedence; none is exploratory.
INTENTS = [
    ("exploratory", r"\b(tell me about|give me an overview of|what are the latest|latest trends in|can you tell me about|overview of|how has|how have|history of)\b"),
    ("comparative", r"\b(compare|difference between|versus|vs\.|pros and cons)\b"),
    ("conversational", r"\b(how are you|hello|hi |hey |good morning|good evening|thanks|thank you|bye|goodbye|see you)\b"),
    ("factual", r"\b(what is|what are|what was|who is|who was|who wrote|who invented|when did|where is|where are|how many|how much|how does|how do|why is|define|explain|describe)\b"),
]
#: Retrieval strategies (fixed values): patterns of each; that with most patterns met wins, the first of equal ones.
STRATEGIES = [
    ("factual", [r"\b(what|who|when|where|which|how many|how much)\b", r"\b(capital|president|invented|discovered|created|built)\b"]),
    ("procedural", [r"\b(how to|how do|how can|steps?|tutorial|guide|configure|install)\b"]),
    ("multi-hop", [r"\b(why|because|reason|cause|effect|lead to|result in)\b"]),
    ("vague", [r"\b(that thing|you know|remember|we discussed|about)\b", r"\b(something|anything|stuff|things?)\b"]),
]
#: Words that speak of an order in time (fixed values).
TEMPORAL = ["then", "after", "before", "next", "later", "previously"]
#: Conjunctions that part a question (fixed values).
PARTING = r"\s+(?:and|plus|also|additionally|as well as|together with|in addition to)\s+"
#: Phrases in which ``and`` parts nothing (fixed values).
WHOLE = r"\b(pride\s+and\s+prejudice|north\s+and\s+south|romeo\s+and\s+juliet|ben\s+and\s+jerry|rock\s+and\s+roll|rhythm\s+and\s+blues|bacon\s+and\s+eggs|fish\s+and\s+chips|peanut\s+butter\s+and\s+jelly)\b"
#: Questions that compare two things (fixed values).
COMPARED = r"(?i)compare\s+(.+?)\s+to\s+(.+?)(?:\?|$|\.\s*)"
DIFFERENCE = r"(?i)what\s+is\s+the\s+difference\s+between\s+(.+?)\s+and\s+(.+?)(?:\?|$|\.\s*)"


def intent(text) -> Column:
    low, out = F.lower(_c(text)), F.lit("exploratory")
    for name, pattern in reversed(INTENTS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(_c(text).isNull(), "exploratory").otherwise(out)


def strategy(text) -> Column:
    """The strategy most of whose patterns are met; factual where none is."""
    low = F.coalesce(F.lower(_c(text)), F.lit(""))
    score = lambda ps: sum((low.rlike(p).cast("int") for p in ps), F.lit(0))
    best = F.array_max(F.array(*(F.struct(score(ps).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ps) in enumerate(STRATEGIES))))
    return F.when(best["n"] == 0, "factual").otherwise(best["name"])


def decompose(text) -> Column:
    """The questions a question is made of: both sides of a comparison, or its parts between conjunctions where at least two have over eight characters; else itself."""
    t = F.trim(_c(text))
    asked = lambda p, g: F.concat(F.lit("What is "), F.trim(F.regexp_extract(t, p, g)), F.lit("?"))
    parts = F.filter(F.transform(F.split(t, "(?i)" + PARTING), lambda x: F.trim(x)), lambda x: F.length(x) > 8)
    whole = F.array(t)
    out = F.when(F.size(parts) >= 2, parts).otherwise(whole)
    for p in (DIFFERENCE, COMPARED):
        out = F.when(t.rlike(p), F.array(asked(p, 1), asked(p, 2))).otherwise(out)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).when(F.lower(t).rlike(WHOLE), whole).otherwise(out)


def tokens_plain(text, stopwords: tuple[str, ...]) -> Column:
    """Words of over two characters in lower case that are no stop words, marks counting as blanks."""
    plain = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(T.words(plain), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def tokens_wide(text) -> Column:
    """Runs of letters and digits in lower case, each Chinese, Japanese or Korean character by itself."""
    cjk = r"぀-ヿ㐀-䶿一-鿿가-힯"
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"[{cjk}]|[\p{{L}}\p{{N}}&&[^{cjk}]]+"), F.lit(0)), F.array().cast("array<string>"))


def phase_key(session, text, modality, stopwords: tuple[str, ...]) -> Column:
    """The key a node's phase is drawn from: session, first three content words, modality."""
    w = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))), lambda x: (F.length(x) > 2) & ~x.isin(*stopwords))
    words = F.array_join(F.slice(w, 1, 3), "_")
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    return F.concat_ws("|", part("s:", _c(session)), part("w:", words), F.concat(F.lit("m:"), F.coalesce(_c(modality), F.lit("text"))))


def phase_of(key) -> Column:
    """md5 of the key modulo 6283 in thousandths."""
    from mnemora.operators.analytics import variant

    return variant(_c(key), 6283) / 1000.0


def attention_line(weight, salience, tier, text) -> Column:
    return F.format_string("[ATTN:%.2f][SAL:%.2f][TIER:%s] %s", _c(weight), _c(salience), F.coalesce(_c(tier), F.lit("semantic")), F.coalesce(_c(text), F.lit("")))


def attention_parts(context) -> Column:
    """(weight, tier, text) of the lines of a context written by ``attention_line``; of other contexts the lines, weighed by 1 over their place."""
    c = _c(context)
    marked = F.regexp_extract_all(c, F.lit(r"\[ATTN:[0-9.]+\](?:\[SAL:[0-9.]+\])?(?:\[TIER:\w+\])?\s*(?:(?!\[ATTN:)[\s\S])+"), F.lit(0))
    head = r"^\[ATTN:([0-9.]+)\](?:\[SAL:[0-9.]+\])?(?:\[TIER:(\w+)\])?\s*"
    one = lambda m: F.struct(F.regexp_extract(m, head, 1).cast("double").alias("weight"), F.regexp_extract(m, head, 2).alias("tier"), F.trim(F.regexp_replace(F.regexp_replace(m, head, ""), r"\s+$", "")).alias("text"))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(lines, lambda x, i: F.struct((1.0 / (i + 1)).cast("double").alias("weight"), F.lit("").alias("tier"), x.alias("text")))
    return F.when(F.size(marked) > 0, F.transform(marked, one)).otherwise(plain)


def sanitised(text, most: int) -> Column:
    """The text without white space around and control characters within, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(_c(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")), 1, most)
