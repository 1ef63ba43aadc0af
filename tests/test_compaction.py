"""Closed dates copied into few files: what readers see before, during and after."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from railtempo.sources import tables

T0 = dt.datetime(2025, 1, 6, 8)
DAY = dt.timedelta(days=1)


def files_under(folder):
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def ids(spark, path, *bounds):
    return sorted(r.id for r in tables.read_range(spark, path, "timestamp", *bounds).collect())


@pytest.fixture()
def stored(spark, tmp_path):
    """Four batches, labelled by digits, of ten rows a day over three days; a null time in one of them."""
    path = str(tmp_path / "facts")
    for b in range(4):
        rows = [(100 * b + k, T0 + (k % 3) * DAY + dt.timedelta(minutes=k), f"S{b}") for k in range(30)]
        tables.append_by_date(spark.createDataFrame(rows + [(999, None, "S")] * (b == 2), "id long, timestamp timestamp, station string"),
                              path, "timestamp", f"00{b}")
    return path, sorted([100 * b + k for b in range(4) for k in range(30)] + [999])


def test_rows_stay_and_files_go(spark, stored):
    path, every = stored
    before = files_under(path)
    assert tables.compact(spark, path, "timestamp", (T0 + 2 * DAY).date()) == [T0.date(), (T0 + DAY).date()]
    assert ids(spark, path) == every and files_under(path) == before
    assert len(files_under(tables.copies_of(path))) == 2
    assert tables.compact(spark, path, "timestamp", (T0 + 2 * DAY).date()) == []  # nothing left to do
    assert tables.remove_compacted(spark, path) == 0  # too new
    assert tables.remove_compacted(spark, path, dt.timedelta(0)) == 8
    assert len(files_under(path)) == len(before) - 8 and ids(spark, path) == every
    assert tables.remove_compacted(spark, path, dt.timedelta(0)) == 0
    inside = [i for i in every if i != 999 and i % 100 % 3 == 1]
    assert ids(spark, path, T0 + DAY, T0 + 2 * DAY - dt.timedelta(minutes=1)) == inside
    assert tables.read_range(spark, path, "timestamp").columns == ["id", "timestamp", "station"]


def test_late_and_repeated_batches(spark, stored):
    path, every = stored
    end = (T0 + 5 * DAY).date()
    assert len(tables.compact(spark, path, "timestamp", end)) == 3
    one = spark.createDataFrame([(500, T0, "late")], "id long, timestamp timestamp, station string")
    tables.append_by_date(one, path, "timestamp", "004")
    assert ids(spark, path) == sorted([*every, 500])
    again = [(k, T0 + (k % 3) * DAY + dt.timedelta(minutes=k), "S0") for k in range(30)]
    tables.remove_compacted(spark, path, dt.timedelta(0))
    tables.append_by_date(spark.createDataFrame(again, "id long, timestamp timestamp, station string"), path, "timestamp", "000")
    assert ids(spark, path) == sorted([*every, 500])  # a micro-batch that is repeated after its date was copied
    assert tables.compact(spark, path, "timestamp", end) == [T0.date()]
    assert ids(spark, path) == sorted([*every, 500])
    tables.remove_compacted(spark, path, dt.timedelta(0))
    assert ids(spark, path) == sorted([*every, 500])
    assert len(files_under(tables.copies_of(path))) == 3 and len(files_under(path)) == 1  # the null time has no date to close


def test_no_batch_left(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([(k, T0 + k * DAY) for k in range(4)], "id long, timestamp timestamp")
    tables.append_by_date(rows, path, "timestamp", "1")
    tables.compact(spark, path, "timestamp", (T0 + 9 * DAY).date())
    assert tables.remove_compacted(spark, path, dt.timedelta(0)) == 4
    assert files_under(path) == [] and ids(spark, path) == [0, 1, 2, 3] and ids(spark, path, T0 + 2 * DAY) == [2, 3]
    assert tables.compact(spark, path, "timestamp", (T0 + 9 * DAY).date()) == []


def test_reader_with_an_older_listing(spark, stored):
    path, every = stored
    early = tables.read_range(spark, path, "timestamp")
    half = (T0 + DAY).date()
    tables.compact(spark, path, "timestamp", half)
    between = tables.read_range(spark, path, "timestamp")
    tables.compact(spark, path, "timestamp", (T0 + 5 * DAY).date())
    for reader in (early, between):
        assert sorted(r.id for r in reader.collect()) == every


def test_failure_before_the_commit(spark, stored, monkeypatch):
    path, every = stored
    whole = tables._facts

    def breaking(*args):
        return whole(*args).withColumn("station", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("station")))

    with monkeypatch.context() as m:
        m.setattr(tables, "_facts", breaking)
        with pytest.raises(Exception, match="lost"):
            tables.compact(spark, path, "timestamp", (T0 + 5 * DAY).date())
    assert ids(spark, path) == every and not files_under(f"{tables.copies_of(path)}/date={T0.date()}")
    assert len(tables.compact(spark, path, "timestamp", (T0 + 5 * DAY).date())) == 3
    assert ids(spark, path) == every


def test_pruned_by_date(spark, stored):
    path, _ = stored
    tables.compact(spark, path, "timestamp", (T0 + DAY).date())
    plan = tables.read_range(spark, path, "timestamp", T0, T0 + dt.timedelta(hours=1))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert len(scans) >= 3 and all("date" in line for line in scans)
