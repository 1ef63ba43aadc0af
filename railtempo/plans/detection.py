"""Detection run: features, detectors, ensemble, storage."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtempo.functions.features import with_calendar
from railtempo.operators.ensemble import combine_detections
from railtempo.operators.filters import last_minutes, latest, lookback
from railtempo.operators.forest import Forest, forest_detections
from railtempo.operators.reconstruct import SequenceModel, sequence_detections
from railtempo.operators.rolling import with_rolling, with_rolling_percentile
from railtempo.session import checkpointed

log = logging.getLogger(__name__)

Detector = Callable[[DataFrame], DataFrame]


def with_features(positions: DataFrame, zscore_hours: int = 1, percentiles: bool = True,
                  slice_minutes: int | None = None) -> DataFrame:
    """Calendar, rolling z-scores and (optionally) percentiles of positions that already carry headway and dwell."""
    rows = with_rolling(with_calendar(positions), zscore_hours=zscore_hours, stat_hours=(), slice_minutes=slice_minutes)
    return with_rolling_percentile(rows, slice_minutes=slice_minutes) if percentiles else rows


@dataclass
class DetectorSet:
    """Named detectors: functions from feature rows to rows of the common detection schema."""

    detectors: dict[str, Detector] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)  # of the last run, by detector
    last_run: datetime | None = None

    def register(self, name: str, detector: Detector | Forest | SequenceModel) -> None:
        if isinstance(detector, Forest):
            model = detector
            self.detectors[name] = lambda df: forest_detections(df, model)
        elif isinstance(detector, SequenceModel):
            model = detector
            self.detectors[name] = lambda df: sequence_detections(df, model)
        else:
            self.detectors[name] = detector

    def is_loaded(self, name: str) -> bool:
        return name in self.detectors

    def stats(self) -> dict:
        return {
            "loaded_models": list(self.detectors), "model_count": len(self.detectors),
            "last_run": self.last_run.isoformat() if self.last_run else None,
        }

    def detect(self, features: DataFrame, isolated: bool = False) -> DataFrame | None:
        """Union of all detectors' output, with each one's place in order of registration (``detector_order``).

        A detector that cannot be planned is logged, noted in ``failures`` and left out. With ``isolated`` the same holds for
        one that fails while running: each one's detections are materialised by themselves.
        """
        found, self.failures = None, {}
        for order, (name, detector) in enumerate(self.detectors.items()):
            try:
                part = detector(features).withColumn("detector_order", F.lit(order))
                part = checkpointed(part) if isolated else part
            except Exception as error:
                log.exception("detector %s failed", name)
                self.failures[name] = f"{type(error).__name__}: {error}"[:500]
                continue
            found = part if found is None else found.unionByName(part)
        self.last_run = datetime.now(timezone.utc)
        return found

    def combined(self, features: DataFrame, mode: str = "time", model_order: list[str] | None = None, isolated: bool = False) -> DataFrame | None:
        """Ensemble of all detections; features of several are those of the detector registered first, or first in ``model_order``."""
        found = self.detect(features, isolated)
        return None if found is None else combine_detections(found, mode, model_order)


def detection_run(positions: DataFrame, detectors: DetectorSet, minutes: int = 60, line: str | None = None,
                  as_of: datetime | None = None) -> DataFrame | None:
    """Combined detections of the last ``minutes``.

    Rolling frames look back an hour, so features are computed over one more hour than is reported. They are
    materialised once for all detectors, each of which runs by itself: see ``detectors.failures`` for those that failed.
    """
    end = F.lit(as_of) if as_of is not None else latest(positions, "timestamp")
    recent = last_minutes(positions, minutes + 60, as_of=end)
    if line:
        recent = recent.filter(F.col("line") == line)
    return detectors.combined(checkpointed(lookback(with_features(recent), minutes, as_of=end)), isolated=True)


def as_anomalies(combined: DataFrame) -> DataFrame:
    """Combined detections in the shape of the anomaly table."""
    several = F.col("model_name") == "ensemble"
    ensemble_meta = F.create_map(
        F.lit("models"), F.to_json("model_counts"),
        F.lit("individual_severities"), F.to_json("individual_severities"),
        F.lit("detection_count"), F.col("detection_count").cast("string"),
    )
    rows = combined.select(
        "station_id", "line", "anomaly_type", "severity", "model_name", "model_version", "features",
        F.when(several, ensemble_meta).otherwise(F.col("meta_data")).alias("meta_data"), "event_time", "source_position_id",
    )
    # an id from what was found alone: the same for whoever stores or delivers it, and when a batch is repeated
    return rows.withColumn("id", F.xxhash64(*[c for c in rows.columns if c not in ("features", "meta_data")]))


def run_summary(positions_checked: int, anomalies: DataFrame) -> DataFrame:
    """Positions checked, anomalies found and their ratio, as one row."""
    return anomalies.agg(F.count("*").alias("anomalies_detected")).select(
        F.lit(positions_checked).alias("positions_checked"), "anomalies_detected",
        F.when(F.lit(positions_checked) > 0, F.col("anomalies_detected") / positions_checked).otherwise(0.0).alias("anomaly_rate"))
