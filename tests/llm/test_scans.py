"""Decontamination, secret and licence scans against plain Python, and on planted cases."""

import math
import re

import numpy as np
from oracle import connect

from railtempo.llm import decontaminate, licenses, queries, secrets

Q = queries.QUERIES


def rows(sf, name):
    return connect(sf).execute(f"select * from {name}").fetchall()


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_overlaps(docs, items, window=13, share=0.8, least=5):
    found, code = set(), {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in words(t)])
    tests = [(i, number(t)) for i, t in items]
    for doc, text in docs:
        own = number(text)
        for item, test in tests:
            if len(test) < least or len(own) < least:
                continue
            padded = np.concatenate((np.full(len(test), -1), own, np.full(len(test), -1)))
            equal = np.lib.stride_tricks.sliding_window_view(padded, len(test)) == test
            width = min(window, len(test))
            sums = np.lib.stride_tricks.sliding_window_view(equal, width, axis=1).sum(-1)
            if sums.max() >= math.ceil(share * width):
                found.add((doc, item))
    return found


def test_decontamination_equals_plain(spark, sf):
    want = plain_overlaps([(d, t) for d, t, *_ in rows(sf, "documents")], rows(sf, "benchmark"))
    got = Q["op5_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 0


def test_decontamination_tolerates_substitutions(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3_000)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([5, 6, 9, 13, 30, 40, 40, 40])] + [(90, None), (91, ""), (92, "one two")]
    docs, planted = [(1_000, None), (1_001, ""), (1_002, "one two three")], set()
    for i, text in items[:8]:
        for step in (0, 5, 6):  # no, every fifth, every sixth word replaced
            own = text.split()
            if step and len(own) < 20:  # too much of it would change
                continue
            for at in range(2, len(own), step) if step else ():
                own[at] = f"x{at}"
            doc = 10 * i + step
            docs.append((doc, " ".join([*rng.choice(vocabulary, 50), *own, *rng.choice(vocabulary, 50)]).upper()))
            planted.add((doc, i))
    docs += [(2_000 + k, " ".join(rng.choice(vocabulary, 400))) for k in range(20)]
    left = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as matched")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(left, spark.createDataFrame(items, "item_id bigint, text string"), ["doc_id"]).collect()}
    assert got == planted == plain_overlaps(docs, items)
    kept = decontaminate.without_leaks(left, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == left.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs + docs[:5] if d not in {p for p, _ in planted})


def test_decontamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.overlaps(docs, items, ["doc_id"]).count() == 0
    assert decontaminate.without_leaks(docs, items).count() == 1
    assert decontaminate.overlaps(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id"), ["doc_id"]).count() == 0


ASSIGNED = re.compile(r"token = \"([0-9a-f]{40})\"|TOKEN = \"([0-9A-F]{40})\"")


def test_secrets_equal_planted_ones(spark):
    sf = "/root/testdata/sf0.01"
    want = {(d, a or b) for d, t, *_ in rows(sf, "documents") for a, b in ASSIGNED.findall(t)}
    got = Q["op4_secrets"](spark, sf).collect()
    assert {(r.doc_id, r.value) for r in got} == want and len(got) == len(want) > 0


def test_secrets_redacted_whole(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = secrets.train(docs)
    key, other = "4f2a9c81b7d3e6054f2a9c81b7d3e605aa17c9d2", "Ab9xQ2kLm7Vt4Rz8Wp1Yc6"
    given = [(1, f"x token = \"{key}\" y {key}", 99, "a"), (1, f"x token = \"{key}\" y {key}", 99, "a"), (None, f'api_key: "{other}" ', 5, "b"),
             (2, None, 0, "c"), (3, "", 0, "d"), (4, "words of no length that thononbleherethandmore matter", 3, "e")]
    df = spark.createDataFrame(given, "doc_id bigint, text string, n_chars bigint, value string").withColumn("before", docs.sparkSession.range(1).select("id").scalar())
    out = secrets.redacted(df, model)
    assert out.columns == df.columns and out.count() == 6
    texts = sorted((r.text or "", r.n_chars) for r in out.collect() if r.doc_id != 2)
    assert all(key not in t and other not in t for t, _ in texts)
    assert sum(secrets.MARK in t for t, _ in texts) == 3
    assert ("words of no length that thononbleherethandmore matter", 53) in texts
    assert [r.text for r in out.filter("doc_id = 2").collect()] == [None]


def test_secrets_without_findings(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id bigint, text string")
    for df in (docs, docs.limit(0)):
        model = secrets.train(df)
        assert model.forest is None and secrets.scan(df, model, ["doc_id"]).count() == 0


LINES = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
         "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}


def test_licences_equal_planted_lines(spark):
    sf = "/root/testdata/sf0.01"
    want = {(d, i, LINES[line]) for d, t, *_ in rows(sf, "documents") for i, line in enumerate((t or "").split("\n")) if line in LINES}
    got = Q["op7_licenses"](spark, sf).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed} == want and len(want) > 0
    assert len(got) <= 1.1 * len(want)


def test_licences_in_odd_texts(spark):
    model = licenses.train(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    given = [(1, None), (2, ""), (3, "\n\n"), (4, "word"), (5, "RELEASED under the MIT license"), (5, "RELEASED under the MIT license"),
             (6, "first\nCopyright 2020 me. Licensed under the Apache License, Version 2.0. All rights reserved."), (7, "of the and in with " * 20_000),
             (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "'x' as family", "1 as paragraph", "2 as line", "3 as similarity")
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(df, model, ["doc_id"]).collect()}
    assert got == {(5, 0, "mit", True), (6, 1, "apache", True), (None, 0, "cc-by-nc", True)}
    assert licenses.scan(df.limit(0), model, ["doc_id"]).count() == 0


def test_secret_training_reads_whole_texts_and_all_findings(spark, monkeypatch):
    """Words of long texts are counted, and no finding is left out of the forest, however many there are of a label."""
    words = secrets.train(spark.createDataFrame([("zqxj " * 30 + "a " * 12_000,), ("plain words",)], "text string")).words
    number = sum((ord(c) - 97) * 26 ** (2 - i) for i, c in enumerate("zqx"))
    assert words[number >> 6] >> (number & 63) & 1
    seen = []
    kept = secrets.checkpointed
    monkeypatch.setattr(secrets, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    findings = spark.range(4_600).selectExpr(
        "concat('Zk7q', lpad(conv(id * 7919, 10, 36), 14, '0')) as value", "if(id < 100, 'api_key = ', 'see ') as before", "'' as after", "int(id < 100) as label")
    model = secrets.train(spark.createDataFrame([("plain words",)], "text string"), findings, trees=3, depth=2)
    assert model.forest is not None and seen[0].count() == 4_600
