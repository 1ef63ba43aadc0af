"""Sequence detector: a linear autoencoder (principal components) over flattened row sequences.

The network of the original task is replaced by its linear form, which MLlib fits in one distributed pass. Threshold,
severity and reporting rules stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.ml.feature import PCA
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.functions import scalar as fx
from railtempo.functions.features import SEQUENCE_FEATURES
from railtempo.functions.scalar import floor_div
from railtempo.operators.ranks import exact_percentiles, with_position
from railtempo.operators.rules import as_detections
from railtempo.operators.scaling import fit_normaliser
from railtempo.operators.segments import map_sorted_groups
from railtempo.operators.sequences import SEQUENCE_KEYS, windows_of
from railtempo.session import checkpointed


@dataclass
class SequenceModel:
    columns: list[str]
    length: int
    normaliser: dict[str, float]
    mean: np.ndarray
    components: np.ndarray
    threshold: float | None = None
    version: str = "v1"
    metrics: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """Flattened sequences to their errors per position."""
        mean, components, length = self.mean, self.components, self.length
        return lambda x: reconstruction_errors(mean, components, length, x)


def reconstruction_errors(mean: np.ndarray, components: np.ndarray, length: int, x: np.ndarray) -> np.ndarray:
    """Mean squared error per sequence position, shape (rows, length)."""
    centred = x - mean
    rest = centred - (centred @ components) @ components.T
    return (rest ** 2).reshape(len(x), length, -1).mean(axis=2)


def normalised(df: DataFrame, columns: list[str], stats: dict[str, float]) -> DataFrame:
    return df.withColumns({
        f"_n{i}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - stats[f"{c}_mean"]) / stats[f"{c}_std"]
        for i, c in enumerate(columns)
    })


def numbered_rows(df: DataFrame, columns: list[str], stats: dict[str, float]) -> DataFrame:
    """Normalised measures and ids with their position per line and direction: all that sequences are made of."""
    measures = [f"_n{i}" for i in range(len(columns))]
    narrow = normalised(df, columns, stats).select(*SEQUENCE_KEYS, "timestamp", "id", *measures)
    return with_position(narrow, SEQUENCE_KEYS, "timestamp", "id").drop("timestamp")


def vectors_of(numbered: DataFrame, columns: list[str], length: int, stride: int = 1) -> DataFrame:
    """Flattened sequences of numbered rows: keys, start, ids, x."""
    measures = [f"_n{i}" for i in range(len(columns))]
    return windows_of(numbered, ["id", *measures], length, stride).select(
        *SEQUENCE_KEYS, "start", F.col("items.id").alias("ids"),
        F.flatten(F.transform("items", lambda r: F.array(*[r[m] for m in measures]))).alias("x"),
    )


def sequence_vectors(df: DataFrame, columns: list[str], length: int, stats: dict[str, float], stride: int = 1) -> DataFrame:
    return vectors_of(numbered_rows(df, columns, stats), columns, length, stride)


def map_windows(numbered: DataFrame, length: int, width: int, work: Callable[[Iterator[tuple]], pa.Table], schema: str,
                block_rows: int = 4096) -> DataFrame:
    """What ``work`` makes of the sequences of whole blocks, as (x, ids, starts): flattened sequences, one a row, the ids of the
    rows from the first on, and each sequence's start.

    Sequences are never sent anywhere; a block of consecutive positions of one line and direction, with the first rows of
    the next block, holds all that start in it.
    """
    measures = [f"_n{i}" for i in range(width)]
    block = floor_div(F.col("position"), block_rows)
    lead_in = (F.col("position") % block_rows < length - 1) & (block > 0)
    blocks = numbered.withColumn("_block", F.explode(F.when(lead_in, F.array(block, block - 1)).otherwise(F.array(block))))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = np.column_stack([table[m].to_numpy() for m in measures])
        position, ids = table["position"].to_numpy(), table["id"].to_numpy()
        own = position // block_rows == table["_block"].to_numpy()

        def windows() -> Iterator[tuple]:
            for begin, end in zip(starts, [*starts[1:], table.num_rows]):
                # the rows of the block itself start sequences, as far as enough rows follow
                n = min(int(own[begin:end].sum()), int(end - begin) - length + 1)
                if n > 0:
                    x = sliding_window_view(rows[begin:begin + n + length - 1], length, axis=0).swapaxes(1, 2).reshape(n, -1)
                    yield x, ids[begin:begin + n + length - 1], position[begin:begin + n]

        return work(windows())

    return map_sorted_groups(blocks.select(*SEQUENCE_KEYS, "_block", "position", "id", *measures), [*SEQUENCE_KEYS, "_block"],
                             ["position"], run, schema)


def sequence_errors(numbered: DataFrame, model: SequenceModel, threshold: float | None = None, block_rows: int = 4096) -> DataFrame:
    """Reconstruction errors of all sequences, computed block by block on narrow rows.

    Without ``threshold``: one row per sequence, ``error`` being its mean. With it: one row per sequence position whose
    error is above it: (id, start, position, error).
    """
    errors_of = model.scorer()

    def errors(windows: Iterator[tuple]) -> pa.Table:
        parts = []
        for x, ids, starts in windows:
            e = errors_of(x)
            if threshold is None:
                parts.append(pa.table({"error": e.mean(axis=1)}))
            else:
                s, k = np.nonzero(e > threshold)
                parts.append(pa.table({"id": ids[s + k], "start": starts[s], "position": k.astype("int32"), "error": e[s, k]}))
        return pa.concat_tables(parts) if parts else empty

    if threshold is None:
        schema, empty = "error double", pa.table({"error": pa.array([], pa.float64())})
    else:
        schema = "id long, start long, position int, error double"
        empty = pa.table({"id": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "position": pa.array([], pa.int32()),
                          "error": pa.array([], pa.float64())})
    return map_windows(numbered, model.length, len(model.columns), errors, schema, block_rows)


def fit_sequences(df: DataFrame, components: int = 8, length: int = 24, threshold_share: float = 0.95,
                  columns: list[str] | None = None, version: str = "v1") -> SequenceModel:
    """Normaliser, components and error threshold from training positions. The normaliser is kept for scoring.

    Fitting passes over the sequences several times. What is materialised are the numbered rows, not the sequences, which
    are ``length`` times larger and cheap to rebuild.
    """
    columns = columns or [c for c in SEQUENCE_FEATURES if c in df.columns]
    stats = fit_normaliser(df, columns).first().asDict()
    numbered = checkpointed(numbered_rows(df, columns, stats))
    vectors = vectors_of(numbered, columns, length).select(array_to_vector("x").alias("v"))
    pca = PCA(k=components, inputCol="v", outputCol="p").fit(vectors)
    # what the components were centred on: close to zero, but not zero where sequences leave rows out
    mean = vectors.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    model = SequenceModel(columns, length, stats, mean, pca.pc.toArray(), version=version)
    scored = checkpointed(sequence_errors(numbered, model))
    model.threshold = exact_percentiles(scored, "error", {"t": threshold_share}).first()["t"]
    summary = scored.agg(F.count("*").alias("n"), F.avg("error").alias("loss")).first()
    model.metrics = {
        "train_samples": float(summary["n"]), "sequence_length": float(length), "final_loss": summary["loss"],
        "threshold": model.threshold, "input_dim": float(len(columns)),
    }
    return model


def position_errors(df: DataFrame, model: SequenceModel) -> DataFrame:
    """Every (sequence, position) whose error is above the threshold: id, start, position, error."""
    return sequence_errors(numbered_rows(df, model.columns, model.normaliser), model, model.threshold)


def sequence_detections(df: DataFrame, model: SequenceModel, report: str = "max", name: str = "sequence_model") -> DataFrame:
    """Detections of kind ``sequence``. ``max`` reports each row once with its largest error, ``all`` every occurrence."""
    hits = position_errors(df, model).select("id", "position", "error")
    if report == "max":
        hits = hits.groupBy("id").agg(F.max("error").alias("error"), F.max_by("position", F.struct(F.col("error"), -F.col("position"))).alias("position"))
    rows = df.join(hits, "id")
    return as_detections(
        rows, F.lit("sequence"), fx.error_severity("error", F.lit(model.threshold)), name, model.version,
        model.columns,
        {"reconstruction_error": F.col("error"), "threshold": F.lit(model.threshold), "sequence_position": F.col("position")},
    )
