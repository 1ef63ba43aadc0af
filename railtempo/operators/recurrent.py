"""Non-linear sequence detector: random recurrent features in both directions, and a ridge read-out.

Every row of a sequence is reconstructed from the rows before and after it, never from itself. Two recurrent nets whose weights are
drawn once and then fixed run over the sequence, one forwards and one backwards. Only the linear read-out from their states is
fitted; it follows from sums of products, which one pass over the numbered rows collects. Threshold, severity and reporting are
those of the linear detector, whose functions take either model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.functions.features import SEQUENCE_FEATURES
from railtempo.operators.ranks import exact_percentiles
from railtempo.operators.reconstruct import map_windows, numbered_rows, sequence_errors
from railtempo.operators.scaling import fit_normaliser
from railtempo.session import checkpointed

Net = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights of the last state, weights of the row, bias


@dataclass
class RecurrentModel:
    columns: list[str]
    length: int
    normaliser: dict[str, float]
    nets: tuple[Net, Net]  # forwards, backwards
    readout: np.ndarray | None = None  # (1 + units forwards + units backwards, columns)
    threshold: float | None = None
    version: str = "v1"
    metrics: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        nets, readout, length = self.nets, self.readout, self.length

        def errors(x: np.ndarray) -> np.ndarray:
            rows = x.reshape(len(x), length, -1)
            return ((rows - states(nets, rows) @ readout) ** 2).mean(axis=2)

        return errors


def random_nets(width: int, units: int, seed: int = 11, memory: float = 0.6) -> tuple[Net, Net]:
    """Fixed weights. ``memory`` is the largest growth of a state from one row to the next; below 1 it fades."""
    draw = np.random.default_rng(seed)

    def one() -> Net:
        recurrent = draw.standard_normal((units, units))
        recurrent *= memory / np.linalg.norm(recurrent, 2)
        return recurrent, draw.standard_normal((units, width)) / np.sqrt(width), draw.uniform(-1, 1, units)

    return one(), one()


def states(nets: tuple[Net, Net], x: np.ndarray) -> np.ndarray:
    """What is known of each row of sequences (n, length, columns) from the others: 1, the forward state after the row before
    it, the backward state after the row behind it. States begin at zero."""
    n, length, _ = x.shape
    out = np.zeros((n, length, 1 + sum(len(bias) for _, _, bias in nets)))
    out[:, :, 0] = 1.0
    first = 1
    for (recurrent, inputs, bias), step in zip(nets, (1, -1)):
        state = np.zeros((n, len(bias)))
        for k in range(length - 1) if step > 0 else range(length - 1, 0, -1):
            state = np.tanh(state @ recurrent.T + x[:, k] @ inputs.T + bias)
            out[:, k + step, first:first + len(bias)] = state
        first += len(bias)
    return out


def state_products(numbered: DataFrame, model: RecurrentModel, block_rows: int = 4096) -> DataFrame:
    """(i, j, value): sums over all rows of all sequences of state i times state j, or times column j less the number of states.

    A task adds up whole blocks and sends one row per cell, so what is shuffled depends on the model's size only, not on a
    sequence's. Cells are as many as the model has states, times states and columns.
    """
    nets, length, wide = model.nets, model.length, 1 + sum(len(bias) for _, _, bias in model.nets)
    width = wide + len(model.columns)

    def add(parts) -> pa.Table:
        total = np.zeros((wide, width))
        for x, _, _ in parts:
            rows = x.reshape(len(x), length, -1)
            z = states(nets, rows).reshape(-1, wide)
            total += z.T @ np.hstack([z, rows.reshape(len(z), -1)])
        i, j = np.indices(total.shape, dtype="int32")
        return pa.table({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    cells = map_windows(numbered, length, len(model.columns), add, "i int, j int, value double", block_rows)
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit_recurrent(df: DataFrame, units: int = 48, length: int = 24, threshold_share: float = 0.95, penalty: float = 1e-4,
                  columns: list[str] | None = None, seed: int = 11, version: str = "v1") -> RecurrentModel:
    """Normaliser, read-out and error threshold from training positions.

    ``penalty`` times the number of rows is added to the squares of all states but the constant. Rows are numbered and
    materialised once and then read twice: for the products, and for the errors whose ``threshold_share`` percentile is the
    threshold. Fails where no line and direction has ``length`` rows.
    """
    columns = columns or [c for c in SEQUENCE_FEATURES if c in df.columns]
    stats = fit_normaliser(df, columns).first().asDict()
    if any(v is None for v in stats.values()):
        raise ValueError("no rows to train on")
    numbered = checkpointed(numbered_rows(df, columns, stats))
    model = RecurrentModel(columns, length, stats, random_nets(len(columns), units, seed), version=version)
    wide = 1 + 2 * units
    products = np.zeros((wide, wide + len(columns)))
    for i, j, value in state_products(numbered, model).collect():  # as many as the model has cells
        products[i, j] = value
    if products[0, 0] == 0:
        raise ValueError(f"no sequence of {length} rows to train on")
    ridge = np.full(wide, penalty * products[0, 0])
    ridge[0] = 0.0
    model.readout = np.linalg.solve(products[:, :wide] + np.diag(ridge), products[:, wide:])
    scored = checkpointed(sequence_errors(numbered, model))
    model.threshold = exact_percentiles(scored, "error", {"t": threshold_share}).first()["t"]
    summary = scored.agg(F.count("*").alias("n"), F.avg("error").alias("loss")).first()
    model.metrics = {
        "train_samples": float(summary["n"]), "sequence_length": float(length), "final_loss": summary["loss"],
        "threshold": model.threshold, "input_dim": float(len(columns)),
    }
    return model
