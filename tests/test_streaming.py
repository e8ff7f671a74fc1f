import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shocklens import streaming
from shocklens.streaming.snapshots import Snapshots


def _figures(spark, *rows):
    frame = spark.createDataFrame(rows, "name string, date string, value double, known string, release int")
    return frame.withColumn("known_from", F.to_date("known")).drop("known")


def _values(store):
    return sorted((r.name, r.date, r.value) for r in store.read().collect())


def test_late_figures_are_merged_once_they_are_known(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "macro"), ["name", "date"])
    assert store.read() is None
    streaming.merge_known(_figures(spark, ("cpi", "2024-12", 1.0, "2025-01-15", 1), ("cpi", "2025-01", 9.0, "2025-02-15", 1)), store, "2025-01-20")
    assert _values(store) == [("cpi", "2024-12", 1.0)]
    streaming.merge_known(_figures(spark, ("cpi", "2024-12", 1.5, "2025-01-15", 2), ("cpi", "2025-01", 2.0, "2025-02-15", 1)), store, "2025-02-20")
    assert _values(store) == [("cpi", "2024-12", 1.5), ("cpi", "2025-01", 2.0)]
    # With an order an old release that comes late does not replace a newer one.
    streaming.merge_known(_figures(spark, ("cpi", "2024-12", 7.0, "2025-01-15", 1)), store, "2025-02-20", ("release",))
    assert _values(store)[0] == ("cpi", "2024-12", 1.5)


def test_a_writer_that_stops_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "macro"), ["name", "date"], buckets=4)
    old = [(n, "2024-12", float(i), "2025-01-01", 1) for i, n in enumerate("abcdefgh")]
    streaming.merge_known(_figures(spark, *old), store, "2025-01-20", batch_id=0)
    before = _values(store)
    new = _figures(spark, ("a", "2024-12", 50.0, "2025-01-01", 2), ("z", "2024-12", 51.0, "2025-01-01", 2))

    def lost(*_):
        raise ConnectionError("lost between rows and version")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lost)
        with pytest.raises(ConnectionError):
            streaming.merge_known(new, store, "2025-01-20", batch_id=1)
    assert _values(store) == before and store.version()["number"] == 1
    reader = store.read()
    assert streaming.merge_known(new, store, "2025-01-20", batch_id=1)
    assert len(_values(store)) == 9 and ("a", "2024-12", 50.0) in _values(store)
    # A reader of the last version goes on seeing it, and a replay changes nothing.
    assert sorted(r.value for r in reader.collect()) == [float(i) for i in range(8)]
    assert not streaming.merge_known(new, store, "2025-01-20", batch_id=1) and store.version()["number"] == 2
    # Only the buckets of the batch's keys are written.
    first, second = (set(f.split("/")[0] for f in store.version()["buckets"].values()) for _ in range(2))
    assert len(first) == 2 and first == second


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (Snapshots(spark, str(tmp_path / "t"), ["name", "date"]) for _ in range(2))
    streaming.merge_known(_figures(spark, ("a", "d", 1.0, "2025-01-01", 1)), one, "2025-01-02")
    stale = two.version()
    streaming.merge_known(_figures(spark, ("a", "d", 2.0, "2025-01-01", 1)), one, "2025-01-02")
    with pytest.raises(RuntimeError, match="another writer"):
        two._publish(stale | {"number": 2})
    assert _values(two) == [("a", "d", 2.0)]


def test_a_replayed_batch_of_alerts_is_in_the_sink_once(spark, tmp_path):
    rows = [("a", "price", 1, "loud"), ("a", "news", 2, "some"), ("b", "price", 3, "calm")]
    seen = spark.createDataFrame(rows, "series string, category string, importance int, text string")
    for batch_id in (0, 1, 0, 1, 1):
        streaming.alerts(seen, batch_id, str(tmp_path / "out"))
    found = [(r.batch, r.series, r.level, r.headline) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == [(0, "a", "high", "loud; some"), (1, "a", "high", "loud; some")]


class _State:
    """A group's state, as the stream hands it on between batches."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def _run(batches, window):
    state, out = _State(), []
    for batch in batches:
        out += list(streaming._flags(("s",), iter([pd.DataFrame(batch, columns=["date", "price"])]), state, window, 2.0))
    return pd.concat(out)


def test_live_flags_over_batches_and_late_closes():
    rng = np.random.default_rng(2)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    closes = [(day(i), float(p)) for i, p in enumerate(100 * np.exp(np.cumsum(rng.normal(size=90) * 0.02)))]
    whole = _run([closes], 10).set_index("date")["z_score"]
    moves = np.diff([p for _, p in closes]) / [p for _, p in closes[:-1]]
    for i in (10, 11, 40, 89):
        before = moves[max(0, i - 11) : i - 1]
        want = (moves[i - 1] - before.mean()) / before.std(ddof=1) if i > 10 else None
        assert whole[day(i)] is None and want is None or abs(whole[day(i)] - want) < 1e-9
    # Cut into batches, out of order inside one, with late, repeated and missing closes: the same scores.
    batches = [closes[:3], closes[3:30][::-1], closes[30:31], closes[31:60] + [(day(5), 1.0), (day(40), 1e9), (day(41), None), (None, 3.0)], [(day(59), 5.0)], closes[60:]]
    split = _run(batches, 10)
    assert split["refused"].sum() == 5 and not split[split["refused"]]["flag"].any()
    kept = split[~split["refused"]].set_index("date")["z_score"]
    assert len(kept) == 90 and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(whole, kept[whole.index], strict=True))


def test_live_flags_without_spread_or_price():
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    flat = _run([[(day(i), 5.0) for i in range(9)]], 3)
    assert flat["z_score"].isna().all() and not flat["flag"].any()
    zero = _run([[(day(i), [5.0, 0.0, 4.0, 5.0, 4.0, 6.0, 4.5, 9.0][i]) for i in range(8)]], 3)
    assert zero["z_score"].isna().tolist() == [True] * 6 + [False] * 2


def test_sessions_and_duplicates(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("s", at(1, 9), "x"), ("s", at(2, 9), "x"), ("s", at(20, 9), "y"), ("s", at(31, 9), "z")]
    spark.createDataFrame(rows, "series string, ts timestamp, document_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, ts timestamp, document_id string").parquet(str(tmp_path / "in"))

    def drained(df, name):
        run = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / name / "rows"))
        run.awaitTermination()
        return spark.read.parquet(str(tmp_path / name / "rows")).collect()

    assert sorted(r.flags for r in drained(streaming.flag_sessions(stream, delay="1 day"), "sessions")) == [1, 2]
    assert sorted(r.document_id for r in drained(streaming.first_articles(stream.withColumnRenamed("ts", "seen_at"), "60 days").select("document_id"), "firsts")) == ["x", "y", "z"]
