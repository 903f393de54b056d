"""Stops from a stream of position reports, with the rules of the batch operator.

A vessel's reports are held until the watermark has passed them and then taken in order of time, so reports
up to ``delay`` late find their place; later ones are dropped.  A stop is emitted once a report in motion
comes more than ``gap_s`` after its last stop point; one still open stays in the state.  The state of a
vessel is its reports within ``delay`` and those of its open stop, which median and radius need.
"""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.functions.geo import EARTH_KM

OUTPUT = "mmsi long, stop_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, n_points long, center_lat double, center_lon double, r95_km double, duration_s double, kept boolean"


def _summary(mmsi: int, number: int, rows: list, min_duration_s: float, max_r95_km: float | None) -> tuple:
    """The stop made of ``rows`` (micros, ordinal, lat, lon, sog)."""
    lat, lon = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    a, o = float(np.median(lat)), float(np.median(lon))
    p, q = np.radians(lat), np.radians(a)
    chord = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(o) - np.radians(lon)) / 2) ** 2
    r95 = float(np.percentile(2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(chord, 0, 1))), 95))
    seconds = (rows[-1][0] - rows[0][0]) / 1e6
    kept = seconds >= min_duration_s and (max_r95_km is None or r95 <= max_r95_km)
    start, end = (pd.Timestamp(r[0], unit="us") for r in (rows[0], rows[-1]))
    return mmsi, number, start, end, len(rows), a, o, r95, seconds, kept


class Machine:
    """An open stop, ``rows``, and the reports since its last stop point, ``after``."""

    def __init__(self, number: int = 0, rows: list | None = None, after: list | None = None):
        self.number, self.rows, self.after = number, rows or [], after or []

    def take(self, row: list, sog: float, gap_s: float) -> list | None:
        """The rows of the stop that this report ends, if it does."""
        if row[4] is not None and row[4] < sog:
            if not self.rows:
                self.number += 1
            self.rows += [*self.after, row]
            self.after = []
        elif self.rows:
            if (row[0] - self.rows[-1][0]) / 1e6 > gap_s:
                done, self.rows, self.after = self.rows, [], []
                return done
            self.after.append(row)
        return None


def stop_stream(points: DataFrame, delay: str = "10 minutes", sog: float = 0.5, gap_s: float = 120.0, min_duration_s: float = 1800.0, max_r95_km: float | None = 0.3) -> DataFrame:
    """Ended stops of the streaming ``points(mmsi, row_ord, ts timestamp, lat, lon, sog)``, in append mode."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, number, rows, after = json.loads(state.get[0]) if state.exists else ([], 0, [], [])
        for frame in frames:
            speed = [None if pd.isna(s) else float(s) for s in frame["sog"]]
            waiting += [[int(u), int(n), float(a), float(o), s] for u, n, a, o, s in zip(frame["micros"], frame["row_ord"], frame["lat"], frame["lon"], speed, strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        machine, out = Machine(number, rows, after), []
        waiting.sort(key=lambda r: r[:2])
        ready = next((i for i, r in enumerate(waiting) if r[0] > passed), len(waiting))
        for row in waiting[:ready]:
            done = machine.take(row, sog, gap_s)
            if done:
                out.append(_summary(key[0], machine.number, done, min_duration_s, max_r95_km))
        waiting = waiting[ready:]
        state.update((json.dumps([waiting, machine.number, machine.rows, machine.after]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    late = points.withWatermark("ts", delay).select("mmsi", "ts", "row_ord", "lat", "lon", "sog", F.unix_micros("ts").alias("micros"))
    return late.groupBy("mmsi").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
