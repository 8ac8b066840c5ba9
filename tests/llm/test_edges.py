"""Empty tables, nulls in every column, clashing names, repeated rows and very long texts, for each corpus operator."""

import pytest
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.llm import ingest_dedup, language, leaks, neighbours, pii, tokens, toxicity

LONG = "the quiet garden keeps a small answer near the river. " * 20_000


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "   ", "de"), (4, LONG, "en"), (4, LONG, "en"), (5, "x", None), (None, "the old garden keeps the answer", "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in ("stretches", "scores", "ids", "kind", "l", "t", "key", "n", "source")})


def test_languages(spark, texts):
    m = language.fit(texts)
    got = {(r.doc_id, len(r.stretches)) for r in language.find_stretches(texts, "text", m).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1)} <= got
    none = language.fit(texts.where("false"))
    assert none.stretches(["some words of a text", None]) == [[("und", 1.0)], []] or none.stretches(["some words of a text"])[0][0][0] in ("und", "other")
    assert language.wrong_or_mixed(language.find_stretches(texts.where("false"), "text", none)).count() == 0


def test_personal_information(spark, texts):
    assert pii.find_pii(texts.drop("kind"), "text", ["doc_id"]).count() == 0
    assert pii.find_pii(texts.where("false"), "text", ["doc_id"]).count() == 0
    kept = pii.redact(texts, "text")
    assert kept.columns == texts.columns and kept.where("text is null").count() == 1 and kept.agg(F.max(F.length("text"))).first()[0] == len(LONG)


def test_batches(spark, texts):
    items = texts.where("doc_id is not null").select(F.monotonically_increasing_id().alias("id"), "text", "key")
    h = ingest_dedup.History(spark, workspace.new_dir(spark, "h"))
    assert h.accept(texts.where("false")).check(items).count() == 1  # the long text again
    assert h.check(items.where("false")).count() == 0


def test_vectors(spark):
    schema = "node_id string, vector array<float>, key int, hash string, place string"
    assert neighbours.neighbour_pairs(spark.createDataFrame([], schema)).count() == 0
    bad = [("a", None, 1, "", ""), ("b", [0.0] * 64, 1, "", ""), (None, [1.0] * 64, 1, "", ""), ("c", [1.0] * 63 + [float("nan")], 1, "", ""), ("d", [1.0] * 64, 1, "", "")]
    assert neighbours.neighbour_pairs(spark.createDataFrame(bad, schema)).count() == 0
    same = [(f"n{k}", [1.0] * 64, 1, "", "") for k in range(9)]
    assert neighbours.neighbour_pairs(spark.createDataFrame(same, schema)).count() == 9 * 5 - 15  # each has the five least others


def test_tokens_and_leaks(spark, texts):
    got = {r.doc_id: len(r.ids) for r in tokens.encode(texts, "doc_id").collect()}
    assert got[1] == got[2] == 0 and got[4] > 100_000
    items = spark.createDataFrame([(7, None, "c"), (8, "", "c"), (9, "keeps a small answer near the river the quiet garden keeps a small", "c")], "item_id bigint, context string, text string")
    found = {tuple(r) for r in leaks.find_leaks(texts, items).distinct().collect()}
    assert (4, 9) in found and not any(i in (7, 8) for _, i in found)


def test_abuse(spark, texts):
    ratings = spark.createDataFrame([(4, "r", None, None), (None, "r", 1, 1), (99, None, 3, 0)], "doc_id bigint, rater string, quality int, toxic int")
    m = toxicity.fit(texts, ratings)
    assert toxicity.flagged(toxicity.score(texts, m), "doc_id").count() == 0
    assert toxicity.rates(toxicity.score(texts, m)).count() == 1
    assert toxicity.fit(texts.where("false"), ratings.where("false")).documents([None, "", LONG]).max() < 0.33
