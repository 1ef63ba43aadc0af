"""The pipeline against plain Python stage by stage, and on odd rows."""

import corpus_pipeline as pipeline
import pytest
from oracle import connect
from test_contracts import coder, plain_components
from test_scans import ASSIGNED, plain_overlaps

from railtempo.llm import quality, queries, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and what it gave, over a whole table."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("steps")
    docs, seen = queries.table(spark, sf, "documents"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        seen.append(({r.doc_id: r.asDict() for r in docs.collect()}, {r.doc_id: r.asDict() for r in out.collect()}, out.columns))
        docs = out
    return sf, seen


def test_stages_keep_columns_and_rows(steps):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]
    for before, after, columns in steps[1][:-1]:
        assert columns == COLUMNS and after.keys() <= before.keys() and len(after) > 0


def test_quality_stage(spark, steps):
    sf, seen = steps
    before, after, _ = seen[0]
    labels = dict(connect(sf).execute("select doc_id, quality from labels").fetchall())
    model = quality.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels").filter(~quality.held_out("doc_id")))
    scores = dict(zip(before, model.scores([r["text"] for r in before.values()])))
    assert after == {d: r for d, r in before.items() if scores[d] >= 0.3}
    assert sum(d in after for d, q in labels.items() if q == 1) / sum(labels.values()) > 0.95


def test_near_duplicate_stage(steps):
    before, after, _ = steps[1][1]
    groups = plain_components({d: simhash.fingerprint(r["text"]) for d, r in before.items()})
    assert after == {d: r for d, r in before.items() if groups[d] == d} and len(after) < len(before)


def test_near_duplicate_stage_broadcasts_no_anchors(spark, monkeypatch):
    """Anchors are dozens of times the fingerprints that Spark sizes them by."""
    links, seen = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda *a: seen.append(links(*a)) or seen[-1])
    docs = spark.range(60).selectExpr("id as doc_id", "concat('words of text ', id, ' and ', id * 7) as text", "'en' as lang", "'s' as source", "id as n_chars")
    assert 0 < pipeline.keep_one_of_each(spark, docs, "").count() <= 60
    seen[0].collect()
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_decontamination_stage(steps):
    sf, seen = steps
    before, after, _ = seen[2]
    items = connect(sf).execute("select item_id, text from benchmark").fetchall()
    leaks = {d for d, _ in plain_overlaps([(d, r["text"]) for d, r in before.items()], items)}
    assert after == {d: r for d, r in before.items() if d not in leaks} and leaks


def test_secret_stage(steps):
    before, after, _ = steps[1][3]
    assert after.keys() == before.keys()
    for d, r in before.items():
        clean = r["text"]
        for a, b in ASSIGNED.findall(clean):
            clean = clean.replace(a or b, secrets.MARK)
        assert after[d]["text"] == clean and after[d]["n_chars"] == len(clean)


def test_token_stage(steps):
    before, after, _ = steps[1][4]
    own = coder()
    assert after.keys() == before.keys()
    assert all(r["ids"] == own.encode_ordinary(before[d]["text"]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for d, r in after.items())


def test_run_equals_stages(spark, steps):
    sf, seen = steps
    got = {r.doc_id: r.asDict() for r in pipeline.run(spark, sf).collect()}
    assert got == seen[-1][1]
    assert pipeline.ORACLE_SQL is None


def test_odd_rows_pass(spark, steps):
    sf, _ = steps
    text = "Plain words that stand in a row. " * 9
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, "s", 1), (3, "x" * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, df, sf)
            assert (out.columns == COLUMNS) == (name != "bpe")
            kept = out.collect()
            if df is not docs:
                assert kept == []
            elif name == "near_duplicates":
                assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == [(0, 0), (1, len(text)), (3, 200_000)]
            elif name in ("decontamination", "secrets", "bpe"):
                assert len(kept) == 6
