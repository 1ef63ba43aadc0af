"""Periodic runs against a quadratic search, on random words and by the registered query."""

import hashlib
import random
import zlib

import pytest
from oracle import connect

from railtempo.llm import queries, runs


def plain_runs(words, least=6, periods=4):
    """Every maximal stretch of two or more periods, found period by period; the smallest period counts."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(least, periods * p))


def plain_collapsed(words, found):
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


@pytest.mark.parametrize("least, periods", [(6, 4), (2, 2), (4, 3)])
def test_random_words(least, periods):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [str(rng.randint(1, rng.choice((1, 2, 3, 5)))) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 5)
                for i in range(a + p, len(words)):
                    words[i] = words[i - p]
                words += ["z", *words[:rng.randint(0, 20)]]
            texts.append(" ".join(words))
        for text, (found, collapsed) in zip(texts, runs._scan(texts, least, periods)):
            wanted = plain_runs(text.split(), least, periods)
            assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
            assert collapsed == plain_collapsed(text.split(), wanted)


def test_long_texts_and_few_jumps():
    for text, wanted in (("a " * 60_000, [(0, 60_000, 1)]), ("a b c " * 9_000 + "x", [(0, 27_000, 3)]),
                         (" ".join(str(i) for i in range(50_000)), [])):
        [(found, _)] = runs._scan([text], 6, 4)
        assert [(r["start"], r["length"], r["period"]) for r in found] == wanted
    # rising, falling and flat values, with and without the table of minima
    rng = random.Random(5)
    for values in ([0, *range(1, 300), 1, *range(300, 0, -1), 2, 0], [0] + [rng.randint(0, 9) for _ in range(500)] + [0], [0] + [3] * 200 + [0]):
        lcp = runs.np.array(values)
        at = runs.np.flatnonzero(lcp > 0)
        for strict in (True, False):
            wanted = [max(j for j in range(i) if values[j] < values[i] or (not strict and values[j] == values[i])) for i in at]
            assert [list(runs._smaller(lcp, at, strict, jumps)) for jumps in (0, 2, 50)] == [wanted] * 3


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_runs"](spark, sf).collect()}
    docs = connect(sf).execute("select doc_id, text from documents").fetchall()
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        found = plain_runs(words)
        planted += bool(found)
        r = got[doc]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted >= 5


def test_odd_rows(spark):
    text = "x y " + "la li\t" * 4 + "  end"
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, " \t\r\n\x0b\x0c ", "a", 0), (None, text, None, 1), (4, text, "b", 2), (4, text, "b", 2), (5, "w " * 300_000, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs int")
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in runs.with_runs(df).collect()), key=str)
    short = ([(1, 8, 2)], "x y la li   end")
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (0, *short), (4, *short), (4, *short), (5, [(0, 300_000, 1)], "w")], key=str)
    assert runs.with_runs(df).columns == ["doc_id", "text", "runs", "collapsed"]
    assert runs.with_runs(df.limit(0)).count() == 0
    assert queries.run_digests(runs.with_runs(queries.with_planted_runs(df))).count() == len(rows)
    assert runs.with_runs(df, runs="text", collapsed="c").columns == ["doc_id", "collapsed", "runs", "text", "c"]
