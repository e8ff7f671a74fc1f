"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shocklens.operators.brief import alert
from shocklens.streaming.snapshots import Snapshots


def daily_counts(news: DataFrame, delay: str = "10 days") -> DataFrame:
    """Articles by series and day of ``seen_at``; a day is final once the watermark has passed its end."""
    return news.withWatermark("seen_at", delay).groupBy("series", F.window("seen_at", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("articles")).select("series", F.to_date("day.start").alias("day"), "articles")


def first_articles(news: DataFrame, delay: str = "10 days") -> DataFrame:
    """The first article of each document id within the watermark."""
    return news.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["document_id"])


def flag_sessions(flags: DataFrame, gap: str = "4 days", delay: str = "10 days") -> DataFrame:
    """Episodes of flags closer than ``gap`` on the calendar."""
    return flags.withWatermark("ts", delay).groupBy("series", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("flags")).select("series", "s.start", "s.end", "flags")


def _z_scores(ring: np.ndarray, moves: np.ndarray, window: int) -> np.ndarray:
    """z of each move against the ``window`` moves before it; ``ring`` holds those before the first. NaN without a full window or spread."""
    out = np.full(len(moves), np.nan)
    line = np.concatenate([ring, moves])
    for at in range(0, len(moves), 4096):
        now = moves[at : at + 4096]
        before = sliding_window_view(line[at : at + len(now) + window - 1], window)
        mean, spread = before.mean(axis=1), before.std(axis=1, ddof=1)
        ok = spread > 1e-12 * np.abs(mean)
        out[at : at + 4096][ok] = (now[ok] - mean[ok]) / spread[ok]
    return out


def _flags(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: int, threshold: float) -> Iterator[pd.DataFrame]:
    last_date, last_price, ring = state.get if state.exists else (None, None, [])
    rows = pd.concat(list(batches)).sort_values(["date", "price"], kind="stable").reset_index(drop=True)
    price = rows["price"].to_numpy(float)
    # In date order each close is new if it is later than all before it; the others, and those without a price, are refused.
    known = rows["date"].notna() & np.isfinite(price)
    fresh = known & ~rows["date"].where(known).duplicated()
    if last_date is not None:
        fresh &= rows["date"].map(lambda d: d is not None and d == d and d > last_date)
    fresh = fresh.to_numpy(bool)
    closes = price[fresh]
    out = rows[["date", "price"]].assign(series=key[0], z_score=None, flag=False, refused=~fresh)
    if len(closes):
        before = np.concatenate([[np.nan if last_price is None else last_price], closes[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            moves = np.where(before != 0, closes / before - 1, np.nan)
        held = np.array([np.nan if x is None else x for x in ring], float)
        held = np.concatenate([np.full(window - len(held), np.nan), held])
        z = _z_scores(held, moves, window)
        out.loc[fresh, "z_score"] = [None if x != x else x for x in z.tolist()]
        out.loc[fresh, "flag"] = np.abs(np.nan_to_num(z)) >= threshold
        ring = [None if x != x else x for x in np.concatenate([held, moves])[-window:].tolist()]
        state.update((rows["date"][fresh].iloc[-1], float(closes[-1]), ring))
    yield out[["series", "date", "price", "z_score", "flag", "refused"]]


def live_flags(prices: DataFrame, window: int = 75, threshold: float = 2.0) -> DataFrame:
    """Daily z of each new close, from the last ``window`` moves kept for its series.

    The state is a series' last date, last close and a ring of moves. A close
    whose date is not later than all before it cannot change z-scores already
    given: it comes out as refused and leaves the state as it is, as does one
    without a date or price (of two closes of a day in one batch the smaller
    stands). A day after a price of zero has no move and leaves no full window.
    """
    return prices.groupBy("series").applyInPandasWithState(
        lambda key, batches, state: _flags(key, batches, state, window, threshold),
        "series string, date date, price double, z_score double, flag boolean, refused boolean", "date date, price double, ring array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_known(batch: DataFrame, store: Snapshots, today: str, order: tuple[str, ...] = (), query: str = "", batch_id: int | None = None) -> bool:
    """foreachBatch body: rows known by ``today`` enter the store in one new version; a replayed batch changes nothing."""
    return store.merge(batch.where(F.col("known_from") <= F.to_date(F.lit(today))), order, query, batch_id)


def alerts(batch: DataFrame, batch_id: int, sink: str) -> None:
    """foreachBatch body: the alerts of a micro-batch of observations, quiet series left out.

    A batch has a folder of its own, which a replay writes anew: every batch is
    in the sink once. Read back, the sink has the column batch.
    """
    alert(batch).where("level <> 'quiet'").write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")
