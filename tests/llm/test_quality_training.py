"""The quality model learns from all labelled texts, whole, however many and however long."""

import numpy as np

from railtempo.llm import quality


def texts_of(rng, words, rows, length):
    return [" ".join(rng.choice(words, length)) for _ in range(rows)]


def tables(spark, good, bad):
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) + len(bad))], "doc_id bigint, quality int")
    return docs, labels


def test_long_texts_are_learnt_from(spark):
    rng = np.random.default_rng(1)
    good, bad = (texts_of(rng, [f"{kind}{k}" for k in range(40)], 12, 4_000) for kind in ("meadow", "gravel"))
    docs, labels = tables(spark, good, bad)
    assert min(map(len, good + bad)) > 20_000
    scores = quality.train(docs, labels).scores([good[0][:300], bad[0][:300]])
    assert scores[0] > 0.8 and scores[1] < 0.2


def test_all_texts_reach_the_calibration_and_the_dictionaries(spark):
    """Of 12,000 good texts, each of 600 wordings comes up twenty times; parts are digested over several levels."""
    rng = np.random.default_rng(2)
    good = [f"wording{k % 600:04d} of the {k % 600:04d}th kind, number {k}" for k in range(12_000)]
    bad = [f"BAD!! {t}" for t in texts_of(rng, ["junk", "spam", "win$", "####"], 600, 12)]
    docs, labels = tables(spark, good, bad)
    small = dict(dictionary_bytes=4_096, part_bytes=32_768, digest_bytes=8_192, fan=2)
    model = quality.train(docs.repartition(3), labels, **small)
    assert model == quality.train(docs.repartition(11), labels.repartition(2), **small)
    scored = quality.with_quality(docs, model, into="p").filter("(p >= 0.5) != (doc_id < 12000)").count()
    assert scored < 60
    # copies of one row weigh in the calibration, not in the dictionaries
    more = quality.train(docs, labels.union(labels.filter("doc_id = 12000").crossJoin(spark.range(50)).drop("id")), **small)
    assert (more.bad, more.good) == (model.bad, model.good) and more.center != model.center


def test_digests_keep_small_parts_and_bound_large_ones():
    rng = np.random.default_rng(3)
    blocks = quality.blocks_of(texts_of(rng, [f"word{k}" for k in range(60)], 300, 200))
    assert quality.digest(blocks[:4], 4_096) == blocks[:4]
    assert 0 < sum(map(len, quality.digest(blocks, 8_192))) <= 8_192 < sum(map(len, blocks))
    assert b"".join(quality.blocks_of(["a" * 1_300])) == b"a" * 788 and quality.blocks_of(["", "b"]) == [b"b"]
