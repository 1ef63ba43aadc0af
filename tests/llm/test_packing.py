"""Packing: every id once, no gaps, no padding; the tokenizer word by word against whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import connect
from tokenizers import Tokenizer

from railtempo.llm import packing, queries


@pytest.fixture(scope="module")
def whole():
    built = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    built.encode_special_tokens = True
    return built


def check(pieces, docs, size=4096):
    """pieces: (doc, start, length, crc, doc_tokens, sequence, offset); docs: ids of each document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        by_doc[doc].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    assert by_doc.keys() == {d for d, ids in docs.items() if len(ids)}
    for doc, own in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(own):
            assert start == at and length > 0 and total == len(docs[doc])
            assert crc == zlib.crc32(np.array(docs[doc][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(docs[doc])
    fills = []
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills, default=0) <= size
    return fills


def test_query(spark, sf, whole):
    docs = {d: whole.encode(t or "", add_special_tokens=False).ids + [2] for d, t in connect(sf).execute("select doc_id, text from documents").fetchall()}
    fills = check(map(tuple, queries.QUERIES["op13_packing"](spark, sf).collect()), docs)
    assert all(f & f - 1 == 0 for f in fills)  # full, or a power of two
    assert sum(f < 4096 for f in fills) <= 12 * spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()


def test_words_like_whole_texts(whole):
    own, rng = packing.WordBpe.load(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    assert own.encode(pa.array([], pa.string())) == []
    letters = [chr(c) for c in (*range(0, 0x250), *range(0x300, 0x370), 0x3a3, 0x3c2, 0x2000, 0x2028, 0x3000, 0x1f600, 0xac00, 0x1100, 0x1161, 0x11a8,
                                0x344, 0x212b, 0x200d, 0xfeff, *range(0x1e00, 0x1e20), *range(0x900, 0x960))]
    texts = ["", None, "<|endoftext|> <|startoftext|>x", "it's we'LL 'S !'s l'été ÀÉß×÷ÿ 12 3a", "x" * 50_000, " \x1c\x85  a"]
    texts += ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(" \n\t'sΣáaBe.") for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    for _ in range(2):  # unknown, then remembered words
        got = own.encode(pa.array(texts))
        assert [g.tolist() for g in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    own.KEPT = 10
    assert own.encode(pa.array(["a b"]))[0].tolist() == whole.encode("a b", add_special_tokens=False).ids
    own.simple = False
    assert own.encode(pa.array(["A b's"]))[0].tolist() == whole.encode("A b's", add_special_tokens=False).ids


def test_level_minimises_squares():
    rng = random.Random(7)
    packer, plain = packing.Packer(16, most_open=10_000), defaultdict(int)
    for doc in range(2_000):
        length = rng.randint(1, 15)

        def squares(level):
            after = dict(plain)
            if level:
                after[level] -= 1
            if level + length < 16:
                after[level + length] = after.get(level + length, 0) + 1
            return sum(n * n for n in after.values())

        able = [h for h in range(16 - length + 1) if h == 0 or plain[h]]
        chosen = packer.level(length)
        assert chosen == min(able, key=lambda h: (squares(h), -h))
        packer.add(doc, np.zeros(length, np.uint32))
        if chosen:
            plain[chosen] -= 1
        if chosen + length < 16:
            plain[chosen + length] += 1
        assert [packer.counts[h] for h in range(1, 16)] == [plain[h] for h in range(1, 16)]


def test_bounded_open_windows():
    rng = np.random.default_rng(8)
    packer, done, docs = packing.Packer(64, most_open=7), [], {}
    for doc in range(500):
        docs[doc] = rng.integers(0, 99, rng.choice([0, 1, 33, 40, 63, 64, 65, 200])).astype(np.uint32)
        done += packer.add(doc, docs[doc])
        assert packer.open <= 7
    assert all(w.fill == 64 for w in done)
    done += packer.finish()
    pieces = []
    for n, w in enumerate(done):
        at = 0
        for p in w.pieces:
            pieces.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, n, at))
            at += len(p.ids)
    fills = check(pieces, docs, 64)
    assert sum(f < 64 for f in fills) <= 6 and packer.finish() == []


def test_odd_rows(spark, whole):
    own = queries.public_words()
    rows = [(None, None, 1), (1, "", 2), (2, "two words", 3), (2, "two words", 3), (3, "long " * 9_000, 4)]
    df = spark.createDataFrame(rows, "name long, body string, sequence_id int").coalesce(1)
    got = packing.pack(df, own, end=2, id_column="name", text="body").collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 3 + 9_001 and {r.id for r in got} == {None, 1, 2, 3}
    assert [r.doc_tokens for r in got if r.id == 2] == [3, 3]
    assert b"".join(r.ids for r in sorted((r for r in got if r.id == 3), key=lambda r: r.start)) == np.array(
        whole.encode(rows[-1][1], add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert {r.id for r in packing.pack(df, own, id_column="name", text="body").collect()} == {2, 3}
    assert packing.pack(df.limit(0), own, id_column="name", text="body").collect() == []
