"""Secrets are judged at each of their places, not at the first alone."""

import re

import pytest

from railtempo.llm import queries, secrets

KEY, OTHER = "4f2a9c81b7d3e6054f2a9c81b7d3e605aa17c9d2", "9b1f7c3d5e8a2046b1c3d5e7f90a2b4c6d8e0f13"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(queries.table(spark, "/root/testdata/sf0.01", "documents"))


def test_bare_first_then_assigned(spark, model):
    given = [(1, f"seen {KEY} in a log.\nThen token = \"{KEY}\" here"), (2, f"in /a/path/{KEY}/x, list {OTHER} {KEY}\ntoken = \"{KEY}\""),
             (3, f"longer{KEY}more and token = \"{KEY}\""), (4, f"only {KEY} bare"), (1, f"seen {KEY} in a log.\nThen token = \"{KEY}\" here"),
             (1, f"another text with token = \"{KEY}\""), (None, f"{KEY}\ntoken = \"{KEY}\""), (5, None), (6, "")]
    df = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "1 as occurrence", "2 as _text_hash")
    for m in (model, secrets.SecretModel(None, model.words)):
        got = secrets.scan(df, m, ["doc_id"]).filter(f"value = '{KEY}'").collect()
        assert sorted((r.doc_id or 0) for r in got if r.doc_id != 4) == [0, 1, 1, 1, 2, 3]
        if m.forest is None:  # a bare key alone is for the forest to judge
            assert all(r.before.endswith('token = "') and r.after.startswith('"') for r in got)
            assert all(r.doc_id != 4 for r in got)
        left = [r.text for r in secrets.redacted(df, m).collect() if r.doc_id not in (4, 5, 6)]
        assert len(left) == 6 and all(KEY not in t and secrets.MARK in t for t in left)


def test_contexts_of_every_place(spark):
    text = f"{KEY}=={KEY} a {KEY} {'b' * 16}\n{KEY}= é🙂 x" + f" {'c' * 20}" * 9 + "é" * 60 + KEY
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    want = [(m.group(), text[max(0, m.start() - secrets.BEFORE):m.start()], text[m.end():m.end() + secrets.AFTER], i)
            for i, m in enumerate(re.finditer(secrets.CANDIDATE, text))]
    assert [tuple(r)[1:] for r in sorted(secrets.candidates(df, ["doc_id"]).collect(), key=lambda r: r.occurrence)] == want
