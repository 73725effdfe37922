"""Unseen words: the pieces that tasks hold change nothing but what travels."""

import pytest

from panelmill.llm import language

TRAIN = [("the old house by the river is old", "en"), ("la maison est près de la rivière", "fr"), ("das alte Haus am Fluß ist alt", "de"), ("漢字 kana", "ja"), (None, "en"), ("zzz", None)]
TEXTS = ["the rivers", "rivers housing maisonette", "qqq 漢語 old", "éé", "Ж", "", None, "unhaus rivière hausboot", "Flußhaus a b", "the rivers"]


@pytest.fixture(scope="module")
def parts(spark):
    model = language.fit(spark.createDataFrame(TRAIN, "text string, lang string"))
    return model, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def test_held_pieces_do_not_change_scores(parts):
    model, docs = parts
    got = [sorted(map(tuple, language.predict(docs, model, p=language.Params(head=2, pieces=n)).collect())) for n in (0, 3, 12, 200_000)]
    assert len(got[0]) == len(TEXTS) and got[0] == got[1] == got[2] == got[3]


def test_pieces_that_are_held_do_not_travel(spark, parts):
    model, _ = parts
    langs, p = ["de", "en", "fr", "ja"], language.Params()
    tokens = language._scores(model, langs, {k: -20.0 for k in range(5)}, p)
    words = spark.createDataFrame([("housing",), ("riviera",), ("Ж",)], "word string")
    out = language._unseen_scores(words, tokens, len(langs), p)
    assert {r.word for r in out.collect()} == {"housing", "riviera"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
