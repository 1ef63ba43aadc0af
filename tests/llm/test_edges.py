"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from railtempo.llm import ann, bpe, chat, graph, quality, queries, simhash, url_filter, warc


@pytest.fixture(scope="module")
def coder():
    return queries.public_bpe()


def test_url_rules_and_list(spark):
    urls = ["http://NET/x", "http://a.net", "https://a.Example.net/en/1?x=1", "example.com/de/", None, "", "://", "http://org/fr/?ref=1#f",
            "HTTP://Example.COM/List/?b=2&a=1&utm_x=3#z", "http://example.com/list?a=1&b=2", "x://y://z/de/", "http://myexample.com/de/", "http://example.com/de/ü",
            "http://example.com/de/ü"]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id int, url string, host string, listed int")
    listed = spark.createDataFrame([("http://example.com/List?a=1&b=2",), ("http://example.com/List?a=1&b=2",), (None,), ("no scheme",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, listed, queries.RULES, blocks=1).collect()}
    assert got == {
        0: ("net", "/x", "net/", "block"), 1: ("a.net", "", None, "allow"), 2: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "/fr/", "org/fr/", "allow"),
        8: ("example.com", "/List/", None, "block"), 9: ("example.com", "/list", None, "allow"), 10: ("y:", "//z/de/", None, "allow"),
        11: ("myexample.com", "/de/", None, "allow"), 12: ("example.com", "/de/ü", "example.com/de/", "block"), 13: ("example.com", "/de/ü", "example.com/de/", "block")}
    assert url_filter.judge(df.limit(0), listed, queries.RULES).count() == 0
    assert url_filter.judge(df, listed.limit(0), queries.RULES).count() == len(urls)


def test_bloom_passes_every_listed_url(spark):
    listed = spark.range(5_000).selectExpr("concat('http://h', id, '.org/', id * 7) as url")
    asked = spark.range(10_000).selectExpr("id", "concat('http://h', id, '.org/', id * 7) as url")
    for blocks in (16, 4_096):
        got = url_filter.judge(asked, listed, [], blocks=blocks)
        assert got.filter("verdict = 'block' and id < 5000").count() == 5_000 and got.filter("verdict = 'block'").count() == 5_000


def test_ann_edges(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(60, 5)).tolist()
    given = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, []), (102, [0.0] * 5), (103, [1.0, None, 1.0, 1.0, 1.0]), (104, [math.nan] + [1.0] * 4),
             (105, [math.inf] + [1.0] * 4), (None, good[0]), (200, [1e300, 2e300, 0.0, 0.0, 1.0]), (201, [1e-300, 2e-300, 0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (301, [2.0, 1.0])]
    given += [(400 + i, good[3]) for i in range(30)] + [given[5]] * 3
    df = spark.createDataFrame(given, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as id")
    got = ann.nearest(df, df.filter("vec_id in (3, 5, 100, 102, 200, 300, 405)"), 4, ann.CrossPolytope(block=16, query_block=2)).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == {3, 5, 200, 300, 405}
    assert [i for i, _ in by[3]] == [400, 401, 402, 403] and [i for i, _ in by[405]] == [3, 400, 401, 402]
    assert len({s for _, s in by[405]}) == 1
    assert [i for i, _ in by[300]] == [301] and abs(by[300][0][1] - 0.8) < 1e-12
    assert by[200][0][0] == 201 and abs(by[200][0][1] - 1) < 1e-12
    assert len({i for i, _ in by[5]}) == 4 and 5 not in {i for i, _ in by[5]}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    two = ann.nearest(df, df.filter("vec_id = 3"), 4, ann.CrossPolytope(polytopes=2)).collect()
    assert [r.vec_id for r in sorted(two, key=lambda r: r["rank"])] == [400, 401, 402, 403]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(7, 7), (2_001, 2_000), (2_000, 2_001)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1_000 + i: 1_000 for i in range(200)}, 2_000: 2_000, 2_001: 2_000}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_simhash_links_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 40)
    prints = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            mask = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.append(int(np.int64(b) ^ np.uint64(mask).astype(np.int64)))
    df = spark.createDataFrame([(p,) for p in prints + [None, prints[0]]], "fingerprint bigint")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert got == {(a, b) for a in set(prints) for b in set(prints) if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_simhash_anchors_are_not_broadcast(spark):
    found = simhash.links(spark.range(3_000).select(F.xxhash64("id").alias("fingerprint")))
    assert found.collect() == []
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_edges(spark):
    long = "word " * 300_000
    given = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two"), (2, long), (1, long + "word"), (None, "one"), (None, "alone here now"), (9, "one"),
             (20, "\x85 a"), (21, "\x85 A")]
    df = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "0 as fingerprint", "1 as id", "2 as component_id")
    got = [(r.id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    want = [(5, 3), (4, 3), (3, 3), (9, 8), (8, 8), (7, 7), (2, 1), (1, 1), (None, 8), (None, None), (9, 8), (20, 20), (21, 20)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, " \t\n"), (8, "ONE"), (7, "one two"), (1, long + "word"), (None, "alone here now"), (20, "\x85 a")], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0
    assert simhash.fingerprint("\x1c a b") != simhash.fingerprint("a b")


def test_warc_edges(spark, tmp_path):
    big = "x" * 300_000 + "é"
    given = [(1, "http://a/\r\nWARC-Type: x", big), (2, None, big), (3, "http://ü/", ""), (4, "u", None), (5, "u", "once"), (None, "n", "once"), (5, "u", "once")]
    df = spark.createDataFrame(given, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as record_type", "3 as refers_to")
    got = sorted((tuple(r)[0] or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df, 0, str(tmp_path)).collect())
    assert got == [(-1, 4, "response", None), (1, 300_002, "revisit", 2), (2, 300_002, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None),
                   (5, 4, "response", None), (5, 4, "response", None)]
    folder = f"file://{tmp_path}/again"
    warc.write_archives(df, folder, least=5)
    read = warc.read_archives(spark, folder)
    only = read.filter("record_type = 'response' and record_id in ('urn:page:2', 'urn:page:3')")
    assert "record_type" in only._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in only.collect()) == [("urn:page:2", big), ("urn:page:3", "")]
    assert read.filter("record_type = 'revisit'").select("record_id", "refers_to", "payload").collect() == [("urn:page:1", "urn:page:2", None)]
    assert read.filter("target_uri is null").count() == 1
    empty = f"{tmp_path}/none"
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reads_foreign_archives(tmp_path):
    import gzip

    plain = [warc.record("response", f"r{i}", "http://h/", None, b"p" * i) for i in (0, 5, 200_000)] + [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"]
    for name, data in (("a.warc", b"".join(plain)), ("b.warc.gz", b"".join(map(gzip.compress, plain))), ("c.warc.gz", b"".join(map(warc.gzip_member, plain)))):
        (tmp_path / name).write_bytes(data)
        with open(tmp_path / name, "rb") as f:
            assert [(r[0], r[1], r[5], r[6]) for r in warc.read_records(f, len(data))] == [
                ("response", "r0", 0, b""), ("response", "r5", 5, b"ppppp"), ("response", "r200000", 200_000, b"p" * 200_000), ("warcinfo", None, 4, b"abcd")]
        with open(tmp_path / name, "rb") as f:
            assert [r[5:] for r in warc.read_records(f, len(data), {"record_id": {"r5"}}, payload=False)] == [(5, None)]
    assert gzip.decompress(warc.gzip_member(plain[1])) == plain[1]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words flow along here " if i % 3 else "BAD!! BAD!! STUFF!! ") * (i % 7 + 1)) for i in range(200)] + [(500, None), (501, ""), (
        502, "good words flow " * 40_000), (None, "x"), (1, "good")], "doc_id bigint, text string").selectExpr("*", "1 as score", "'a' as quality")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(500, 1), (501, 0), (3, None), (None, 1), (7, 9)], "doc_id bigint, quality int")
    model = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.with_quality(docs, model, into="p").collect()
    assert len(got) == 205 and all(0 <= r.p <= 1 for r in got)
    assert sum((r.p >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 200) > 195
    for few in (labels.limit(0), labels.filter("quality = 1")):
        flat = {r.p for r in quality.with_quality(docs, quality.train(docs, few), into="p").collect()}
        assert len(flat) == 1 and 0 < flat.pop() < 1
    assert quality.with_quality(docs.limit(0), model).count() == 0


def test_bpe_chunks_equal_whole_texts(spark, coder):
    rng = np.random.default_rng(4)
    pieces = [" the", "n't", "'re", "'", "  ", "\n\n", "\t x", "é", "日本", "123", "!!", " \u3000", "\x1c", "a" * 70, "<|endoftext|>", "🙂"]
    texts = ["".join(rng.choice(pieces, n)) for n in (1, 30, 90, 400, 900, 900)] + ["a" * 2_000, " " * 999, "b" * 200 + " c d" * 100, "'re" * 300, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (4, texts[4])], "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as key")
    own = coder.encoding
    for chunk, overlap in ((64, 24), (100, 100), (10_000, 100)):
        got = bpe.with_bytes(bpe.with_ids(df, coder, chunk=chunk, overlap=overlap), coder).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            assert list(r.ids) == own.encode_ordinary(r.text or ""), (chunk, r.doc_id)
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.with_ids(df.limit(0), coder).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_edges(spark, coder):
    long = "\\<" * 20_000
    given = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
             (3, 2, "assistant", "more"), (4, None, None, None), (4, 5, "assistant", None), (4, 5, "assistant", None), (None, 0, "user", long), (None, 1, "a<b\\", "</turn>"),
             (5, 0, "user", "hi")]
    df = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as a", "2 as at", "3 as ids")
    got = {r.conv_id: r for r in chat.digests(df, coder).collect()}
    turns = {1: [("user", "hi"), ("assistant", "yes")], 3: [("user", "hi"), ("assistant", "no"), ("assistant", "more")],
             4: [("", ""), ("assistant", ""), ("assistant", "")], None: [("user", long), ("a<b\\", "</turn>")], 5: [("user", "hi")]}
    turns[2] = turns[1]
    assert got.keys() == turns.keys()
    for conv, want in turns.items():
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(want), digest("".join(f"{r}\n{t}\n" for r, t in want)))
        assert got[conv].loss_sha256 == digest("".join(t for r, t in want if r == "assistant"))
    assert chat.digests(df.limit(0), coder).count() == 0


def test_chat_tree_attends_to_ancestors_only(spark, coder, sf):
    conversations = queries.table(spark, sf, "conversations")
    more = conversations.filter("turn < 2").selectExpr("conv_id + 1000000 as conv_id", "turn", "role", "text")
    both = conversations.union(more)
    nodes, leaves, members = chat.prefix_tree(both, coder)
    rows = sorted(nodes.collect())
    stream, at = [], 0
    for r in rows:
        assert r.offset == at and r.length == len(r.ids)
        stream += r.ids
        at += r.length
    prefixes, talks = set(), {}
    for r in both.orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    for t in talks.values():
        prefixes |= {tuple(t[:i + 1]) for i in range(len(t))}
    assert len(rows) == len(prefixes) < sum(map(len, talks.values()))
    by_offset = {r.offset: r for r in rows}
    shown = {r.leaf: r for r in leaves.collect()}
    for m in members.collect():
        leaf = shown[m.leaf]
        whole = [t for begin, end in leaf.intervals for t in stream[begin:end]]
        text = "".join(f"<turn>{r}<text>{t}</turn>\n".replace("\\", "\\\\") for r, t in talks[m.conv_id])
        assert bytes(coder.encoding.decode_bytes(whole)).decode() == text
        seen = 0
        for offset in leaf.offsets:  # in order: position ids run on, and a node sees exactly what came before it
            node = by_offset[offset]
            assert node.position == seen
            assert [t for begin, end in node.ancestors for t in stream[begin:end]] == whole[:seen]
            seen += node.length
