"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector; its hash is the signed axis it is
nearest to. A query probes the axes it is next nearest to as well, in every table.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railtempo.session import checkpointed


@dataclass(frozen=True)
class CrossPolytope:
    """Parameters of an index. ``polytopes`` hashes are joined in a bucket number, so a table has (2 * dimension) ** polytopes buckets:
    one suits up to some ten million vectors of 64 dimensions, two some billions.

    Groups of a bucket are cut so that at most about ``block`` vectors meet ``query_block`` queries in one task's memory.
    """

    tables: int = 8
    probes: int = 12
    polytopes: int = 1
    block: int = 8_192
    query_block: int = 1_024
    seed: int = 7

    def rotated(self, unit: np.ndarray, table: int, polytope: int) -> np.ndarray:
        size = 1 << max(0, unit.shape[1] - 1).bit_length()
        signs = np.random.default_rng([self.seed, size, table, polytope]).choice([-1.0, 1.0], (3, size))
        y = np.zeros((len(unit), size))
        y[:, :unit.shape[1]] = unit
        for s in signs:
            y = hadamard(y * s)
        return y

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        number = np.zeros(len(unit), dtype=np.int64)
        for p in range(self.polytopes):
            y = self.rotated(unit, table, p)
            axis = np.abs(y).argmax(1)
            number = number * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return number

    def nearest_buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """All bucket numbers of a table per row, nearest axes first."""
        score = np.zeros((len(unit), 1))
        for p in range(self.polytopes):
            y = self.rotated(unit, table, p)
            signed = np.stack([y, -y], 2).reshape(len(y), -1)
            score = (score[:, :, None] + signed[:, None, :]).reshape(len(y), -1)
        return np.argsort(-score, axis=1, kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, size, half = len(x), x.shape[1], 1
    while half < size:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return x / np.sqrt(size)


def tame(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component in [0.5, 1): no cosine changes, no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def pair_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of equal rows of two matrices; equal pairs give equal values wherever they stand."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _valid(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of a batch's vectors that can take part, by dimension."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), vectors):
        if i is None or not v.is_valid or not len(v) or v.values.null_count:
            continue
        x = v.values.to_numpy()
        if np.isfinite(x).all() and x.any():
            at = groups.setdefault(len(x), ([], []))
            at[0].append(i)
            at[1].append(x)
    for dimension, (own, rows) in groups.items():
        yield dimension, np.array(own, dtype=np.int64), np.stack(rows)


def _hash(df: DataFrame, index: CrossPolytope) -> DataFrame:
    """(dim, table, bucket, id) of every vector in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _valid(batch.column(0), batch.column(1)):
                t = tame(x.astype(np.float64))
                unit = t / np.sqrt((t * t).sum(1, keepdims=True))
                for table in range(index.tables):
                    n = len(ids)
                    yield pa.record_batch({"dim": np.full(n, dim), "tab": np.full(n, table), "bucket": index.buckets(unit, table), "id": ids})

    return df.mapInArrow(run, "dim bigint, tab bigint, bucket bigint, id bigint")


KEYS = ["dim", "tab", "bucket", "part", "query_part"]


def _salted(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number of each id and vector, so that different vectors of one id can be split."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64).reshape(len(x), -1)
    odd = np.random.default_rng(words.shape[1]).integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (words * odd).sum(1, dtype=np.uint64)
    return ids.astype(np.uint64) ^ h ^ (h >> np.uint64(32))


def _mix(salted: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part in [0, parts) from ``_salted`` numbers alone."""
    h = (salted ^ (salted >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _emit(dim: int, table: int, bucket: np.ndarray, ids: np.ndarray, raw: list[bytes], own: np.ndarray, others: np.ndarray, own_first: bool):
    """Rows of one table: each goes to its own part, once for every part of the other side."""
    row = np.repeat(np.arange(len(ids)), others)
    other = np.arange(len(row)) - np.repeat(np.cumsum(others) - others, others)
    mine = own[row]
    part, query_part = (mine, other) if own_first else (other, mine)
    n = len(row)
    return pa.record_batch({
        "dim": np.full(n, dim), "tab": np.full(n, table), "bucket": bucket[row], "part": part, "query_part": query_part, "id": ids[row],
        "vector": pa.array([raw[i] for i in row.tolist()], pa.binary())})


PLACED = "dim bigint, tab bigint, bucket bigint, part bigint, query_part bigint, id bigint, vector binary"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, index: CrossPolytope = CrossPolytope(), id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all vectors with another id.

    Score is the cosine of the original components in double precision; ties go to the smaller id. Vectors that are null, empty,
    zero or hold nulls or non-finite numbers take no part, nor do rows without id; vectors of another length are
    another space with its own index. Rows that repeat an id count as one item with the best of their scores.

    All vectors are indexed. A query probes ``probes`` buckets of each table, and in every table goes on until the probed ones hold
    at least ``k`` other ids, so none comes back short unless there are no more. Only bucket counts
    reach the driver (tables * buckets numbers). Hot buckets are cut into parts on both sides, by id and vector.
    """
    double = dict(vectors.dtypes)[vector] == "array<double>"
    kind = np.float64 if double else np.float32
    given = F.col(vector) if double or dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<float>")
    rows = checkpointed(vectors.select(F.col(id_column).cast("bigint").alias("id"), given.alias("v")).distinct())
    asked = checkpointed(queries.select(F.col(id_column).cast("bigint").alias("id"), given.alias("v")).distinct())
    # an id whose vectors lie in several buckets counts in the first of them only, so any buckets hold as many ids as counted or more
    held_by = _hash(rows, index).groupBy("dim", "tab", "id", "bucket").agg(F.count("*").alias("n")).groupBy("dim", "tab", "id").agg(
        F.min("bucket").alias("home"), F.collect_list(F.struct("bucket", "n")).alias("all"))
    counts = held_by.select("dim", "tab", "home", F.inline("all")).groupBy("dim", "tab", "bucket").agg(
        F.sum("n").alias("n"), F.count_if(F.col("home") == F.col("bucket")).alias("ids")).collect()
    sizes: dict[tuple[int, int], np.ndarray] = {}
    distinct_ids: dict[tuple[int, int], np.ndarray] = {}
    for r in counts:
        space = (2 << max(0, r.dim - 1).bit_length()) ** index.polytopes
        sizes.setdefault((r.dim, r.tab), np.zeros(space, dtype=np.int64))[r.bucket] = r.n
        distinct_ids.setdefault((r.dim, r.tab), np.zeros(space, dtype=np.int64))[r.bucket] = r.ids

    def probes(dim: int, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of the non-empty buckets that queries probe in one table."""
        have = sizes.get((dim, table))
        if have is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = index.nearest_buckets(unit, table)
        held, ids = have[order], distinct_ids[dim, table][order]
        before = np.cumsum(ids, 1) - ids
        use = (np.arange(order.shape[1]) < index.probes) | (before < k + 1)
        row, at = np.nonzero(use & (held > 0))
        return row, order[row, at]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _valid(batch.column(0), batch.column(1)):
                for at in range(0, len(ids), 256):
                    t = tame(x[at:at + 256].astype(np.float64))
                    unit = t / np.sqrt((t * t).sum(1, keepdims=True))
                    for table in range(index.tables):
                        bucket = probes(dim, unit, table)[1]
                        yield pa.record_batch({"dim": np.full(len(bucket), dim), "tab": np.full(len(bucket), table), "bucket": bucket})

    wanted = {(r.dim, r.tab, r.bucket): -(-r.n // index.query_block) for r in asked.mapInArrow(
        probed, "dim bigint, tab bigint, bucket bigint").groupBy("dim", "tab", "bucket").agg(F.count("*").alias("n")).collect()}
    query_parts = {key: np.zeros_like(have) for key, have in sizes.items()}
    for (dim, table, bucket), n in wanted.items():
        query_parts[dim, table][bucket] = n
    parts = {key: -(-have // index.block) for key, have in sizes.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _valid(batch.column(0), batch.column(1)):
                t = tame(x.astype(np.float64))
                unit, raw = t / np.sqrt((t * t).sum(1, keepdims=True)), [v.tobytes() for v in x.astype(kind)]
                salted = _salted(ids, x.astype(kind))
                for table in range(index.tables):
                    b = index.buckets(unit, table)
                    yield _emit(dim, table, b, ids, raw, _mix(salted, parts[dim, table][b]), query_parts[dim, table][b], True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _valid(batch.column(0), batch.column(1)):
                for at in range(0, len(ids), 256):
                    own, t = ids[at:at + 256], tame(x[at:at + 256].astype(np.float64))
                    unit, raw = t / np.sqrt((t * t).sum(1, keepdims=True)), [v.tobytes() for v in x[at:at + 256].astype(kind)]
                    salted = _salted(own, x[at:at + 256].astype(kind))
                    for table in range(index.tables):
                        row, b = probes(dim, unit, table)
                        if len(row):
                            yield _emit(dim, table, b, own[row], [raw[i] for i in row.tolist()], _mix(salted[row], query_parts[dim, table][b]),
                                        parts[dim, table][b], False)

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            return t["id"].to_numpy(), tame(np.frombuffer(b"".join(t["vector"].to_pylist()), dtype=kind).reshape(t.num_rows, -1).astype(np.float64))

        out_query, out_id, out_score = [], [], []
        if left.num_rows and right.num_rows:
            ids, x = matrix(left)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            asked_ids, q = matrix(right)
            for i, query in enumerate(asked_ids.tolist()):
                rough = unit @ (q[i] / np.sqrt((q[i] * q[i]).sum()))
                rough[ids == query] = -np.inf
                own_best = np.maximum.reduceat(rough, starts)  # of each id, so that repeated ones take one place
                limit = np.partition(own_best, -k)[-k] - 1e-9 if len(starts) > k else -2.0
                near = np.flatnonzero(rough >= max(limit, -2.0))
                exact = pair_cosine(np.broadcast_to(q[i], (len(near), q.shape[1])), x[near])
                best = np.lexsort((ids[near], -exact))
                _, first = np.unique(ids[near][best], return_index=True)
                best = best[np.sort(first)][:k]
                out_query += [query] * len(best)
                out_id.append(ids[near][best])
                out_score.append(exact[best])
        return pa.table({"query_id": pa.array(out_query, pa.int64()), "vec_id": np.concatenate(out_id or [np.empty(0, np.int64)]),
                         "score": np.concatenate(out_score or [np.empty(0)])})

    found = rows.mapInArrow(place, PLACED).groupBy(*KEYS).cogroup(asked.mapInArrow(ask, PLACED).groupBy(*KEYS)).applyInArrow(
        rerank, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
