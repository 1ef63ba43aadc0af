"""Licence notices over several lines, and payloads read back."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from railtempo.llm import licenses, queries, warc

MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the
 * "Software"), to deal in the Software without restriction.
 */

int main() { return 0; }"""
BSD = """intro line one

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. nothing"""
GPL = """# This program is free software: you can redistribute
# it and/or modify it under the terms of the GNU General
# Public License as published by the Free Software Foundation."""
APACHE = """Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES"""
DECOY = """The committee gave permission to redistribute the seats,
and the driver's licence of any person obtaining
a copy of the minutes was returned free of charge."""


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(queries.table(spark, "/root/testdata/sf0.01", "documents"))


def test_wrapped_notices(spark, model):
    given = [(1, MIT), (2, BSD), (3, GPL), (4, APACHE), (5, DECOY), (None, GPL), (7, f"a\x01b\x02c\r\n \r\n{GPL}"), (7, f"a\x01b\x02c\r\n \r\n{GPL}"),
             (8, f"first\nReleased under the MIT License.\nlast\n{GPL}")]
    df = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("*", "1 as lines", "'x' as _id", "2 as _s")
    found = licenses.scan(df, model, ["doc_id"]).collect()
    confirmed = sorted(((r.doc_id or 0, r.paragraph, r.lines, r.family) for r in found if r.confirmed))
    assert confirmed == [(0, 0, 3, "gpl"), (1, 1, 3, "mit"), (2, 2, 3, "bsd"), (3, 0, 3, "gpl"), (4, 0, 3, "apache"), (7, 2, 3, "gpl"), (8, 1, 1, "mit")]
    # a confirmed stretch takes the place of its lines
    assert all(r.lines == 3 and r.confirmed for r in found if r.doc_id in (1, 2, 3, 4, 7))


def test_paragraphs_equal_plain_walk(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", " ", "# x y", "word", "* two words *", "---", "\t"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [None, "", "\n", "one", "\n\none\ntwo\n\n"]

    def plain(text):
        lines, out, held = [x.strip("\t\n /*#;%!<>|-") for x in (text or "").split("\n")], set(), []
        for i, line in enumerate([*lines, ""]):
            if line:
                held.append((i, line))
                out.add((i, 1, line))
                continue
            if len(held) > 1:
                out.add((held[0][0], len(held), " ".join(x for _, x in held)))
            held = []
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {tuple(r) for r in licenses.paragraphs(df, ["id"], "t").collect()}
    assert got == {(i, *p) for i, t in enumerate(texts) for p in plain(t)}


def test_payload_facts_come_from_payloads(spark, tmp_path):
    good = warc.record("response", "r1", "http://h/", None, b"payload one")
    bad = warc.record("response", "r2", "http://h/", None, b"payload two").replace(b"payload two", b"damaged bit")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(bad))
    (tmp_path / "b.warc").write_bytes(warc.record("response", "r3", "http://h/", None, b"cut off here")[:-10])
    read = warc.with_payload_facts(warc.read_archives(spark, str(tmp_path)))
    assert {r.record_id: (r.payload_bytes, r.intact) for r in read.collect()} == {"r1": (11, True), "r2": (11, False), "r3": (6, False)}
    import base64
    import hashlib

    data = [b"", b"a", bytes(range(256)), None]
    df = spark.createDataFrame([(d,) for d in data], "payload binary").withColumn("s", warc.base32_sha1("payload"))
    want = [d if d is None else base64.b32encode(hashlib.sha1(d).digest()).decode() for d in data]
    assert [r.s for r in df.select("s").collect()] == want
    assert read.filter(F.col("record_id") == "none").count() == 0
