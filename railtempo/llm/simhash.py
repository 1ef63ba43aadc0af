"""SimHash fingerprints and their near-duplicate groups by anchor points of a covering code.

Anchors are the codewords of two perfect Golay codes, side by side over the low 46 bits of a fingerprint. Each 23-bit half
lies within distance 3 of exactly one codeword, so every fingerprint has one *home* anchor. A fingerprint within ``bits`` of
it differs from that anchor by at most 3 per half plus ``bits`` in all, hence sending each fingerprint to every anchor within
that radius brings each linked pair together at the home of its smaller member; there the full 64 bits are compared.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.llm.graph import components
from railtempo.session import checkpointed

HALF = 23
RADIUS = 3
GENERATOR = 0b101011100011  # of the perfect binary Golay code, as a polynomial over GF(2)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text: majority of the XXH64 bits of its word shingles, 0 without words."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) >= words:
        ends, begins = ends[words - 1:], begins[:len(tokens) - words + 1]
    else:
        ends, begins = ends[-1:], begins[:1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(begins.tolist(), ends.tolist())], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 3) -> DataFrame:
    """Adds the fingerprint of each whole text; only the text column visits Python."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), words) for t in batch], pa.int64())

    return docs.withColumn(into, of(F.col(text)))


def _remainder(x: np.ndarray) -> np.ndarray:
    """Syndrome: remainder of 23-bit polynomials divided by the generator."""
    x = x.astype(np.int64)
    for bit in range(HALF - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def anchor_offsets(extra: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For e = 0..extra the error patterns by syndrome: at e = 0 the only one of weight <= 3, else all of weight 3 + e.
    These travel to the tasks (a third of a megabyte for two bits)."""
    rows = []
    for e in range(extra + 1):
        weights = range(RADIUS + 1) if e == 0 else (RADIUS + e,)
        patterns = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(HALF), w)], dtype=np.int64)
        syndrome = _remainder(patterns)
        order = np.argsort(syndrome, kind="stable")
        starts = np.searchsorted(syndrome[order], np.arange(2049))
        rows.append((patterns[order], starts))
    return tuple(rows)


def _near(half: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) of all codewords that differ from ``half`` by one of a table's patterns."""
    patterns, starts = table
    syndrome = _remainder(half)
    count = starts[syndrome + 1] - starts[syndrome]
    row = np.repeat(np.arange(len(half)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, half[row] ^ patterns[starts[syndrome][row] + within]


def anchors(prints: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor within reach of the fingerprints; tables are ``anchor_offsets``."""
    low, high = prints & (1 << HALF) - 1, prints >> HALF & (1 << HALF) - 1
    found = []
    for e, table in enumerate(tables):
        row, first = _near(low, table)
        for f, other in enumerate(tables[:len(tables) - e]):
            inner, second = _near(high[row], other)
            found.append((row[inner], second << HALF | first[inner], np.full(len(inner), e == f == 0)))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def links(prints: DataFrame, bits: int = 2, column: str = "fingerprint") -> DataFrame:
    """(a, b): all pairs of different fingerprints that differ in 1 to ``bits`` bits, a < b, each once.

    A fingerprint has only so many others within ``bits`` (2,080 for two), so links grow in proportion to the fingerprints
    however they cluster. Nulls are left out.
    """

    tables = anchor_offsets(bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.column(0).slice(at, 20_000).to_numpy()
                row, anchor, home = anchors(part, tables)
                yield pa.record_batch({"anchor": anchor, "print": part[row], "home": home})

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint becomes dozens of rows: small ones must not be put together into few tasks first
    distinct = prints.select(F.col(column).alias("print")).filter("print is not null").distinct().repartition(tasks)
    placed = distinct.mapInArrow(spread, "anchor bigint, print bigint, home boolean")
    # Spark takes the anchors for as few as the fingerprints, dozens of times too few, and would broadcast them
    homes = placed.filter("home").select("anchor", F.col("print").alias("a")).hint("merge")
    return homes.join(placed.select("anchor", F.col("print").alias("b")), "anchor").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")


def near_duplicates(docs: DataFrame, bits: int = 2, id_column: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fingerprint, component_id) of every row; component_id is the smallest id linked to it over any steps.

    Equal fingerprints are one node, so copies cost nothing beyond their first. Rows without id are linked like others and
    give no component id of their own: a component made of such rows alone has a null one. Texts that are null, empty or
    without words have fingerprint 0. Repeated rows are all returned. Other columns are not looked at.
    """
    rows = checkpointed(with_fingerprint(
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")), "t", words=words,
    ).select("id", F.xxhash64("t").alias("text_hash"), "fingerprint"))
    nodes = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    linked = components(links(nodes, bits), "a", "b")
    named = nodes.join(linked, nodes["fingerprint"] == linked["node"], "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fingerprint", "component_id"), "fingerprint").select(
        "id", "text_hash", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, bits: int = 2, words: int = 3) -> DataFrame:
    """The documents left when one of each near-duplicate group stays: the row with the component's id (rows without id: one per
    fingerprint). Of rows repeating that id, the one with the smallest text hash stays, once."""
    groups = near_duplicates(docs, bits, words=words)
    chosen = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "component_id", F.when(
        F.col("id").isNull(), F.col("fingerprint")).alias("own")).agg(F.min("text_hash").alias("text_hash"))
    kept = chosen.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    stays = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["_id"]) & (hashed["_hash"] == kept["_hash"]), "left_semi")
    return stays.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
