"""The corpus operators against brute force, exact round trips and held-out texts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.llm import ingest_dedup, language, leaks, markup, neighbours, pii, tokens, toxicity


# --- 4: personal information


NAMES = frozenset("owen graham judith".split())


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to ann.lee+x@mail.example.com, please", [("email", "ann.lee+x@mail.example.com")]),
        ("reach judith_x at box dot invalid now", [("email", "judith_x at box dot invalid")]),
        ("deploy@build-24:~/run$ tail -f; the decorator @app.post('/v1')", []),
        ("Call +44 20 7946 0346 or (415) 555-0173.", [("phone", "+44 20 7946 0346"), ("phone", "(415) 555-0173")]),
        ("Звоните 8(812)0007133, +7 (495) 000-80-63", [("phone", "8(812)0007133"), ("phone", "+7 (495) 000-80-63")]),
        ("number 954-27-1958, QQ 49 08 12 C, DNI 92953455J, Паспорт 1422 № 877486", [("id_number", "954-27-1958"), ("id_number", "QQ 49 08 12 C"), ("id_number", "92953455J"), ("id_number", "1422 № 877486")]),
        ("DNI 92953455A has a wrong letter; epoch 1740043352; v8.11.14; MEM-6600-89535; 2023-03-16", []),
        ("She moved to 36 Larkfield Avenue, in May", [("address", "36 Larkfield Avenue")]),
        ("An Mühlgasse 134a; Calle del Molino 137; 13 bis place du Marché; ул. Мельничная, 26", [("address", "Mühlgasse 134a"), ("address", "Calle del Molino 137"), ("address", "13 bis place du Marché"), ("address", "ул. Мельничная, 26")]),
        ("🙂 I met Owen D. Harrow and Graham G. about the Kestgate cluster", [("person", "Owen D. Harrow"), ("person", "Graham G.")]),
        ("Remember that Harrow, Owen lives here", [("person", "Harrow, Owen")]),
        (None, []),
        ("", []),
    ],
)
def test_items(text, want):
    items = pii.find_items(text, NAMES)
    assert [(k, text[a:b]) for k, a, b in items] == want


def test_persons_by_shape_and_context_alone():
    found = lambda t: [t[a:b] for k, a, b in pii.find_items(t) if k == "person"]
    assert found("Zsófia Nagy met Priya Raman and Kwame Mensah, then left.") == ["Zsófia Nagy", "Priya Raman", "Kwame Mensah"]
    assert found("I spoke with Ngozi Adeyemi about it. The old Ferry Bridge met New standards.") == ["Ngozi Adeyemi"]
    assert found("Меня зовут Айгуль Сейтова, а это кластер Марлоу") == ["Айгуль Сейтова"]
    assert found("The Kestgate cluster near Tarnvale was asked for data") == []


def test_given_names_are_learnt_from_the_corpus(spark):
    rng = random.Random(5)
    given, family = [f"{a}{b}" for a in ("Ama", "Bo", "Ciro") for b in ("ra", "lin", "tek")], [f"{a}{b}" for a in ("Kor", "Mev", "Tas") for b in ("mond", "wick", "ova")]
    rows = []
    for k in range(400):
        g, f = rng.choice(given), rng.choice(family)
        rows.append((rng.choice([f"we saw {g} {rng.choice('ABC')}. {f} there", f"later {g} {f} came", f"it was {rng.choice('ABC')}. {f}", "The Great Wall stands", "THE LOUD TEXT STANDS"]),))
    names = pii.learn_given(spark.createDataFrame(rows + [(None,)], "content string").repartition(3), "content")
    assert names == {g.lower() for g in given}
    assert pii.learn_given(spark.createDataFrame([], "content string"), "content") == frozenset()
    t = "today bolin Mevwick and AMARA KORMOND; Korwick, Ciratek; later Boratek Xanwick"
    assert [t[a:b] for _, a, b in pii.find_items("ask " + t.replace("bolin", "Bolin").replace("AMARA KORMOND", "Amara Kormond"), names)][:0] == []
    assert [k for k, *_ in pii.find_items("later Bolin Unseen came, and Tasova, Amara", names)] == ["person", "person"]


def test_long_parts_links_and_many_items():
    local, name = "a" * 300, "Sur" + "n" * 200
    t = f"x {local}@mail.example and {name}, Owen"
    assert [(k, z - a) for k, a, z in pii.find_items(t, NAMES)] == [("email", 313), ("person", len(name) + 6)]
    assert [k for k, *_ in pii.find_items("see https://docs.example.org/v1/617-555-0101 or tel:+442079460346, mail jo@bücher.example")] == ["phone", "email"]
    many = "mail a.b@c.example; " * 20_000
    start = time.time()
    assert len(pii.find_items(many)) == 20_000
    assert time.time() - start < 10

def test_long_text_and_redaction():
    long = "plain words here. " * 20_000 + "Mail a.b@c.example"
    assert [(k, a) for k, a, _ in pii.find_items(long)] == [("email", len(long) - 13)]
    t = "Hi Owen Harrow, call 020 7946 0621!"
    assert pii.redact_text(t, pii.find_items(t, NAMES)) == "Hi [PERSON], call [PHONE]!"
    assert pii.redact_text(None, []) is None


def test_find_pii_gives_code_points_from_one(spark):
    df = spark.createDataFrame([("1", "🙂 x@y.example", "clash"), ("2", None, None)], "rec_id string, content string, kind string")
    assert [tuple(r) for r in pii.find_pii(df.drop("kind"), "content", ["rec_id"]).collect()] == [("1", "email", 3, 11)]


# --- 1: languages

SAMPLE = {
    "en": "the old garden keeps a quiet memory near the river and the new bridge opens again|what happens when the teacher finds the small answer",
    "de": "der alte Garten speichert die ruhige Antwort neben der Brücke und das neue Fenster öffnet wieder|was passiert, wenn der Lehrer die kleine Antwort findet",
    "ru": "старый сад хранит тихую память около реки и новый мост открывается снова|что будет, если учитель находит маленький ответ",
    "es": "el jardín viejo guarda la memoria tranquila cerca del río y el puente nuevo abre otra vez|qué pasa cuando el maestro encuentra la respuesta pequeña",
}


@pytest.fixture(scope="module")
def model():
    samples = [(k, language.sentences(s + ".")) for k, v in SAMPLE.items() for s in v.split("|") for _ in range(3)]
    return language.learn(samples, language.load_pieces(language.vocabulary_path()))


def test_stretches(model):
    of = lambda t: [x for x, _ in model.stretches([t])[0]]
    assert of("The garden keeps the answer near the bridge. Der Garten speichert die Antwort.\nDas Fenster öffnet die Brücke.") == ["en", "de"]
    assert of("СТАРЫЙ САД ХРАНИТ ПАМЯТЬ") == ["ru"]
    assert of("staryy sad khranit tikhuyu pamyat") == ["ru"]
    assert of("el jardin viejo guarda la memoria cerca del rio") == ["es"]
    for none in (None, "", "12345", "https://docs.example.org/v1/4711", "x@y.example", "🙂🙂", "---"):
        assert of(none) == []
    assert 0.9 < model.stretches(["the old garden keeps a quiet memory"])[0][0][1] <= 1
    assert model.stretches([]) == []


def test_text_of_no_language_learnt_is_other_and_confidence_tells(model):
    lang, c = model.stretches(["kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki"])[0][0]
    assert lang == "other" or c < 0.5


def segmentations(w):
    return [[w]] + [[w[:k], *rest] for k in range(1, len(w)) for rest in segmentations(w[k:])]


def test_forward_sums_all_segmentations_and_expectations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb"]
    probs = np.array([[0.5, 0.1], [0.25, 0.2], [0.125, 0.3], [0.05, 0.1], [0.02, 0.2], [0.01, 0.1]])
    m, p = language.PieceModel(("x", "y"), pieces, probs), dict(zip(pieces, probs))
    for w in (b"ab", b"abab", b"bbaab"):
        want = sum(np.prod([p.get(x, np.zeros(2)) for x in s], axis=0) for s in segmentations(w))
        assert np.allclose(np.exp(m.forward([w])[0]), want)
    long = m.forward([b"ab" * 2000])[0]  # no word is too long to be summed whole
    assert np.isfinite(long).all() and np.allclose(long, 2000 * (m.forward([b"ab" * 1000])[0] - m.forward([b"ab" * 999])[0]), rtol=0.01)
    m2 = language.PieceModel(("x",), [b" ", b"a", b"b", b"ab"], np.array([[1.0], [0.5], [0.25], [0.125]]))
    total = dict(zip(m2.pieces, m2.expect(["ab"], np.array([[4.0]]))[:, 0]))
    assert np.isclose(total[b"ab"], 2.0) and np.isclose(total[b"a"], 2.0) and np.isclose(total[b" "], 4.0)


def test_labels(spark):
    rows = [("en-US", "en"), ("German", "de"), (" RUS ", "ru"), ("und", None), ("", None), (None, None), ("unknown", None), ("tlh", "tlh")]
    got = spark.createDataFrame(rows, "l string, w string").select(language.label_of("l").alias("x"), "w").collect()
    assert all(r.x == r.w for r in got)


# --- 8: encoding


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    rng = random.Random(1)
    long = "".join(rng.choice("abcdeéф中") for _ in range(20_000))  # one pre-token
    texts = [long, None, "", " ", "a" * 3000, "ab" * 700, "<|endoftext|> x", "é" * 300, "🙂" * 100, "don't I'LL  \n\n x", "aaaaaaa"]
    texts += ["".join(rng.choice("ab é中1.'\n") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id").collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts)}


# --- 6: batches against history


def brute_cases(history, items):
    near = lambda a, b: (len(a & b) >= 0.7 * len(a | b)) if a or b else False
    kept = [(frozenset(ingest_dedup.words_of(t)), t) for t in history if t and t.strip()]
    out = set()
    for k, t in items:
        if not t or not t.strip():
            continue
        w = frozenset(ingest_dedup.words_of(t))
        if any(t == x or near(w, v) for v, x in kept):
            out.add(k)
        else:
            kept.append((w, t))
    return out


def test_dedup_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}x" for k in range(900)]
    text = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(25, 60)))
    history = [text() for _ in range(40)] + [None, " ", "???"]

    def rework(t):
        w = t.split()
        for _ in range(len(w) // 25):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return rng.choice([" ".join(w).upper(), "<p>" + " ".join(w) + "</p>", " ".join(w[len(w) // 2 :] + w[: len(w) // 2]), ". ".join(w)])

    texts = []
    for _ in range(160):
        base = [t for t in history + texts if t and len(t) > 30]
        texts.append(rng.choice([text(), rework(rng.choice(base)), rng.choice(base), None, "???"]))
    texts += [texts[0] or "one more text of its own"] * 60  # a group of copies
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id bigint, text string").repartition(3)
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h")).accept(spark.createDataFrame([(t,) for t in history], "text string"))
    got, want = {r.id for r in h.check(df).collect()}, brute_cases(history, enumerate(texts))
    assert got == want
    # what was accepted is history for the next batch
    again = spark.createDataFrame([(0, next(t for t in texts if t and len(t) > 30)), (1, text())], "id bigint, text string")
    assert {r.id for r in h.check(again).collect()} == {0}


def test_dedup_of_scattered_changes_and_large_groups(spark):
    rng = random.Random(11)
    vocab = [f"w{k}x" for k in range(700)]
    history = [rng.sample(vocab, rng.randrange(20, 70)) for _ in range(120)]

    def rework(w, share):
        out, k = list(w), int(share * len(w))
        for at in rng.sample(range(len(w)), k):
            out[at] = rng.choice(vocab)
        return rng.sample(out, len(out)) if rng.random() < 0.3 else out

    # at 0.17 of the words replaced 0.71 of the distinct ones agree, at 0.3 about 0.54
    texts = [rework(rng.choice(history), rng.choice([0.15, 0.17, 0.17, 0.3])) for _ in range(250)]
    texts += [rework(texts[0], 0.05) for _ in range(60)]
    new = rng.sample(vocab, 60)
    texts += [new] + [rework(new, 0.06) for _ in range(80)]  # a large group of the batch
    texts += [rework(rng.choice(texts), 0.17) for _ in range(80)]
    history, texts = [" ".join(w) for w in history], [" ".join(w) for w in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id bigint, text string").repartition(3)
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h")).accept(spark.createDataFrame([(t,) for t in history], "text string"))
    want = brute_cases(history, enumerate(texts))
    assert {r.id for r in h.check(df).collect()} == want and 200 < len(want) < len(texts) - 50


def test_a_later_batch_is_held_against_accepted_items_word_by_word(spark):
    rng = random.Random(4)
    vocab = [f"w{k}x" for k in range(600)]
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h")).accept(spark.createDataFrame([("a b c",)], "text string"))
    first = [rng.sample(vocab, 60) for _ in range(20)]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "id bigint, text string").repartition(2)
    assert h.check(frame(first)).count() == 0

    def scattered(w):  # every sixth word replaced: few chunks stay whole, 0.71 of the words agree
        out = list(w)
        for k in range(0, len(w), 6):
            out[k] = f"new{rng.random()}"
        return rng.sample(out, len(out))

    later = [scattered(w) for w in first] + [rng.sample(vocab, 60)]
    want = brute_cases([" ".join(w) for w in first], [(k, " ".join(w)) for k, w in enumerate(later)])
    assert {r.id for r in h.check(frame(later)).collect()} == want and len(want) == 20
    assert {r.id for r in h.check(frame([later[20], rng.sample(vocab, 50)]), append=False).collect()} == {0}


def test_the_chunk_table_holds_one_row_a_chunk(spark):
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h"))
    h.accept(spark.createDataFrame([("the same boilerplate text of every page stands here " + str(k),) for k in range(50)], "text string").repartition(4))
    rows = h._read("chunks", ingest_dedup._CHUNKS).collect()
    assert len({r.chunk for r in rows}) == len(rows) and max(r.df for r in rows) == 50


def test_dedup_of_nothing(spark):
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h"))
    assert h.check(spark.createDataFrame([], "id bigint, text string")).count() == 0


def test_a_run_of_characters_is_taken_apart_once():
    rng = random.Random(5)
    letters = list("abcΣσßéİ½ﷺ日_7-.,<>/'") + ["e\u0301", "\u00a0", "\x1c", "\n", " ", " ", " ", "<b>", "</p>", "<p\nclass=x>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    known = ingest_dedup.Vocabulary({})
    for t in texts:
        found = list(known.words(t))
        names = list(known.number)
        assert [names[k] for k in found] == ingest_dedup.words_of(t)
    taken = []
    known = type("Counting", (ingest_dedup.Vocabulary,), {"__missing__": lambda self, run: taken.append(run) or super(type(self), self).__missing__(run)})({})
    for k in range(500):
        list(known.words(f"The same Words come <b>again</b> {k % 5}"))
    assert len(taken) == 10


def test_signatures_do_not_depend_on_how_texts_are_put_together():
    rng = random.Random(6)
    vocab = ["The", "of", *(f"w{k}x" for k in range(80))]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 90))) for _ in range(120)] + ["???", "a", "a a a", "!"]
    rows = lambda **at: [r for b in ingest_dedup.Signer({7: 1}, 0.7, **at).batches(list(range(len(texts))), texts) for r in b.to_pylist()]
    whole = rows()
    key = lambda r: {c: sorted(v) if isinstance(v, list) else v for c, v in r.items()}
    assert [key(r) for r in whole] == [key(r) for r in rows(rows=1)] == [key(r) for r in rows(words=50, kept=20)]
    for r, t in zip(whole, texts):
        w = ingest_dedup.words_of(t)
        assert r["n"] == len(set(w)) and len(r["words"]) == max(1, r["n"]) and len(set(r["chunks"])) == len(r["chunks"]) == len(r["sizes"])
        assert r["total"] == sum(r["sizes"]) and len(r["prefix"]) == (ingest_dedup.first_words(r["n"], 0.7) if w else 0)
    assert len({tuple(sorted(r["words"])) for r in whole[-4:]}) == 3  # texts without words are told apart, "a" and "a a a" are one


@pytest.mark.parametrize("small", [2, 200])
def test_pairs_of_words_are_bounded_by_their_places(small):
    rng = random.Random(8)
    base = [rng.sample(range(300), rng.randrange(12, 40)) for _ in range(40)]
    sets = [sorted(set(w)) for w in base] + [sorted({rng.randrange(300) if rng.random() < 0.12 else x for x in rng.choice(base)}) for _ in range(160)]
    rows = []
    for k, w in enumerate(sets):
        sketch = np.zeros(2, np.uint64)
        for x in w:
            sketch[x >> 6 & 1] ^= np.uint64(1 << (x & 63))
        rows += [(x, k, len(w), sketch[0], sketch[1], at, k % 3 > 0) for at, x in enumerate(w[: ingest_dedup.first_words(len(w), 0.7)])]
    rows.sort(key=lambda r: (r[0], r[2]))
    columns = [np.array(c) for c in zip(*rows)]
    got = set(zip(*(x.tolist() for x in ingest_dedup.sketch_pairs(*columns, 0.7, small))))
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b) for a in range(200) for b in range(a) if (a % 3 or b % 3) and share(sets[a], sets[b]) >= 0.7}
    assert len(want) > 100 and want <= got
    # a pair that first meets too late for all that it would have to share is not held up
    late = [np.array(c) for c in zip((9, 0, 10, 0, 0, 3, True), (9, 1, 10, 0, 0, 3, True))]
    late[3] = late[4] = np.zeros(2, np.uint64)
    assert ingest_dedup.sketch_pairs(*late, 0.7, small).shape == (2, 0)


# --- 7: neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 64))
    x = (centres[rng.integers(0, 30, 600)] + 0.35 * rng.standard_normal((600, 64))).astype(np.float32)
    x[590:] = x[5]  # copies
    rows = [(f"n{k:04}", v.tolist()) for k, v in enumerate(x)]
    bad = [("z1", None), ("z2", [1.0]), ("z3", [0.0] * 64), ("z4", [float("nan")] * 64), rows[0], (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "node_id string, vector array<float>").withColumn("key", F.lit(1))
    got = {(r.node_a, r.node_b) for r in neighbours.neighbour_pairs(df, cell_rows=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = (u @ u.T).round(12)
    np.fill_diagonal(s, -9)
    want = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5]:
            if s[i, j] >= 0.8:
                want.add((f"n{min(i, j):04}", f"n{max(i, j):04}"))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)
    assert not any(a.startswith("z") or b.startswith("z") for a, b in got)
    # a busy cell split among tasks, and cells of more than a block, give the same
    assert {(r.node_a, r.node_b) for r in neighbours.neighbour_pairs(df, cell_rows=64, queries_per_task=100, block=3_000).collect()} == got


def test_bounds_hold_for_nearly_all():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est, width = neighbours.Codes(x, x[:50].mean(0), neighbours.rotation(64)).bounds(x[:100])
    assert (np.abs(est - x[:100] @ x.T) <= width).mean() > 0.95


# --- 9: leaks


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(26, 90)))) for k in range(20)] + [(99, None), (98, "brief note"), (97, "seven rather unusual little words stand here")]
    docs, want = [(0, None), (1, ""), (200, "x BRIEF y"), (201, "some unusual little words stand"), (202, "if 5 < 6 then unusual little words stand and 7 > 3"), (203, "unusual words")], {(200, 98), (201, 97), (202, 97)}
    for k in range(2, 120):
        filler = [rng.choice(vocab) for _ in range(80)]
        item = rng.randrange(20)
        w = items[item][1].split()
        share = rng.choice([0, 0.25, 0.5, 0.7, 1.0])
        n = int(np.ceil(share * len(w)))
        a = rng.randrange(0, len(w) - n + 1)
        quote = w[a : a + n]
        for i in range(0, n - 9, 10):
            quote[i + rng.randrange(10)] = "changed"
        text = " ".join(filler[:40] + quote + filler[40:])
        docs.append((k, rng.choice([text, text.upper(), "<b>" + text.replace(" ", "  ") + "</b>", text.replace("word1", "wörd1").replace("wörd1", "word1") + "."])))
        if share >= 0.5:
            want.add((k, item))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, context string")
    got = {tuple(r) for r in leaks.find_leaks(d.drop("item_id"), i, block_windows=300).distinct().collect()}
    assert got == want
    assert leaks.find_leaks(d.where("false"), i).count() == 0
    assert leaks.find_leaks(d, i.where("false")).count() == 0


@pytest.mark.parametrize("length, n", [(31, 20), (52, 30), (70, 40), (39, 20), (58, 30), (100, 50), (64, 64)])
def test_quotes_with_evenly_replaced_words(length, n):
    rng = random.Random(length)
    item = [f"word{k}" for k in rng.sample(range(5000), length)]
    search = leaks.Items([(7, item)], part=0.5, noise=10, sizes=(3, 4, 6, 8), radius=3)
    docs = []
    for a in range(length - n + 1):
        quote, k = item[a : a + n], n // 10
        for i in range(1, k + 1):  # the clean runs differ by one word at most
            quote[i * (n - k) // (k + 1) + i - 1] = f"strange{a}x{i}"
        docs.append([f"f{k}x" for k in range(20)] + quote + [f"g{k}x" for k in range(20)])
    assert search.find(docs, {}) == [(d, 0) for d in range(len(docs))]


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    q = np.concatenate([a[:50] ^ np.uint64(0b1011 << 13), rng.integers(0, 2**63, 50, dtype=np.uint64)])
    got = set(zip(*map(list, leaks.BlockIndex(a, 3).search(q))))
    assert got == {(i, j) for i in range(100) for j in range(300) if bin(int(q[i]) ^ int(a[j])).count("1") <= 3}


def test_a_lone_bracket_is_no_tag():
    t = "if 5 < 6 then you worthless idiot go away. and 7 > 3"
    assert markup.without_tags(t) == t
    assert markup.without_tags('<p class="x">a</p><br/>b<!-- c > d --><!DOCTYPE html><input disabled>', "|") == "|a||b|||"
    assert "idiot" in [w for s in toxicity._Words().sentences(t) for w in s]
    assert leaks.words_of(t) == ingest_dedup.words_of(t)


# --- 10: language of abuse


def test_hidden_spellings():
    w = toxicity._Words().sentences
    assert w("You 1d10t, you c l o w n, you lоsеr, you i​diot, fiiiilth m***n")[0] == "you idiot you clown you loser you idiot filth *".split()


def test_held_out_accuracy_and_empty(spark):
    rng = random.Random(3)
    nice = ["the report quotes the word idiot", "the naked eye sees the gap", "rats damaged the cable", "a quiet garden keeps the answer", "the new bridge opens again"]
    bad = {"abusive": ["you are a worthless {} and nobody wants you", "listen you {} get lost"], "hateful": ["those {} are vermin and should be driven out"], "sexual": ["she stroked the naked {} and moaned with lust"]}
    names = {"abusive": "idiot moron loser clown".split(), "hateful": "people immigrants".split(), "sexual": "guest dancer waiter".split()}

    def doc():
        s, kinds = [rng.choice(nice) for _ in range(5)], set()
        if rng.random() < 0.4:
            k = rng.choice(list(bad))
            s.insert(rng.randrange(5), rng.choice(bad[k]).format(rng.choice(names[k])))
            kinds.add(k)
        return ". ".join(s) + ".", kinds

    train = [doc() for _ in range(300)]
    m = toxicity.learn([(float(bool(k)), t) for t, k in train], bits=16)
    test = [doc() for _ in range(200)]
    p = m.documents([t for t, _ in test]) >= 0.4
    right = [set(np.array(toxicity.KINDS)[row]) == kinds for row, (_, kinds) in zip(p, test)]
    assert np.mean(right) > 0.95
    df = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "You are a worthless moron and nobody wants you.", None)], "doc_id bigint, text string, source string")
    scored = toxicity.score(df, m)
    assert [tuple(r) for r in toxicity.flagged(scored, "doc_id").collect()] == [(3, "abusive")]
    assert {(r.source, r.documents) for r in toxicity.rates(scored).collect()} == {(None, 2), ("s", 1)}
    assert toxicity.learn([]).documents(["x", None]).max() < 0.4
