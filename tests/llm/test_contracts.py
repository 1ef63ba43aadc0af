"""Each operator's query on a whole small table, against plain Python over the same rows."""

import base64
import dataclasses
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import connect, difference

from railtempo.llm import quality, queries, simhash

Q = queries.QUERIES


def rows(sf, name):
    return connect(sf).execute(f"select * from {name}").fetchall()


def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    assert difference(Q[name](spark, sf), connect(sf), queries.SQL[name]) is None


def test_ann_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {i: np.array(v, dtype=np.float64) for i, v, _ in rows(sf, "embeddings")}
    got = Q["op2_ann"](spark, sf).collect()
    hit = total = 0
    for query in (i for i in vectors if i % 50 == 0):
        q = vectors[query]
        scores = sorted(((-(q @ v) / np.sqrt((q @ q) * (v @ v)), i) for i, v in vectors.items() if i != query))
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        best = dict((i, -s) for s, i in scores)
        assert all(abs(best[i] - s) < 1e-12 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in scores[:5]})
        total += 5
    assert hit / total >= 0.9


def plain_components(prints, bits=2):
    ids, parent = sorted(prints), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(spark, sf):
    import xxhash

    prints = {}
    for doc, text, *_ in rows(sf, "documents"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    want = plain_components(prints)
    got = Q["op3_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(got) == len(prints)


def test_warc_round_trip(spark, sf):
    pages = {p: (h or "").encode() for p, _, h in rows(sf, "pages")}
    last = {}
    for page, html in pages.items():
        last[html] = max(page, last.get(html, page))
    got = {tuple(r) for r in Q["op6_warc"](spark, sf).collect()}
    assert got == {(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == p else "revisit",
                    None if last[h] == p else last[h]) for p, h in pages.items()}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = {d: q for d, q, _ in rows(sf, "labels")}
    got = Q["op8_quality"](spark, sf).collect()
    assert len(got) == len(rows(sf, "documents"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.97
    good = [r for r in held if label[r.doc_id] == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.985
    # the difference of sizes is all that a score comes from: its ranks, and their reverse with the dictionaries swapped
    assert area([r.score for r in held], [label[r.doc_id] for r in held]) > 0.97
    docs = queries.table(spark, sf, "documents")
    model = quality.train(docs, queries.table(spark, sf, "labels").filter(~quality.held_out("doc_id")))
    texts = [t for _, t, *_ in rows(sf, "documents")][:300]
    swapped = dataclasses.replace(model, bad=model.good, good=model.bad, center=-model.center)
    assert np.allclose(swapped.differences(texts), -model.differences(texts)) and model.slope > 0
    order = np.argsort(model.differences(texts), kind="stable")
    assert (np.diff(model.scores(texts)[order]) >= 0).all() and (np.diff(swapped.scores(texts)[order]) <= 0).all()


def area(scores, labels):
    """Share of (good, bad) pairs in the right order; ties count half."""
    good, bad = (np.array([s for s, q in zip(scores, labels) if q == k]) for k in (1, 0))
    return ((good[:, None] > bad).sum() + (good[:, None] == bad).sum() / 2) / (len(good) * len(bad))


def test_bpe_digests(spark, sf):
    own = coder()
    texts = {d: t for d, t, *_ in rows(sf, "documents")}
    got = Q["op9_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chat_digests(spark, sf):
    hard = "\\### Assistant: </turn> ok"
    talks = {-7: [(0, "user", hard), (1, "assistant", hard)]}
    for conv, turn, role, text in rows(sf, "conversations"):
        talks.setdefault(conv, []).append((turn, role, text or ""))
    got = {r.conv_id: r for r in Q["op10_chat"](spark, sf).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        plain = sum(len("<turn><text></turn>\n") + len(role) + len(t) for _, role, t in turns)
        assert r.formatted_chars == plain + sum(x.count("\\") + x.count("<") for _, role, t in turns for x in (role, t))


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(3)
    prints = rng.integers(-2 ** 63, 2 ** 63 - 1, 300)
    tables = simhash.anchor_offsets(2)
    row, anchor, home = simhash.anchors(prints, tables)
    assert sorted(row[home]) == list(range(300))
    assert len({(r, a) for r, a in zip(row, anchor)}) == len(row)
    homes = dict(zip(row[home], anchor[home]))
    for i in range(300):
        bits = rng.choice(64, rng.integers(0, 3), replace=False)
        other = np.array([prints[i] ^ np.int64(np.uint64(sum(1 << int(b) for b in bits)).astype(np.int64))])
        assert homes[i] in simhash.anchors(other, tables)[1]
