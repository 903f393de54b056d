"""Arrival-time regression with a long short-term memory layer, in numpy.

``fit_windows`` learns one value per window from the layer's last state; ``fit_sequences`` one value per step
of padded sequences, whose padding steps change no state and count in no loss.  Both train with Adam on the
mean squared error, the last fifth of the sequences validating.  Features and targets are standardised inside
the model, by the training steps; predictions are in the target's unit.

Training happens on the driver, on about ``max_rows`` sequences chosen by a hash of their key, so it needs
bounded memory; prediction is distributed, with the weights (some 100 kB) broadcast.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def initial(features: int, units: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    limit = np.sqrt(6 / (features + units))
    square, _ = np.linalg.qr(rng.normal(size=(4 * units, units)))
    bias = np.zeros(4 * units)
    bias[units : 2 * units] = 1.0  # gates come as input, forget, cell, output; states are kept at first
    return {"wx": rng.uniform(-limit, limit, (features, 4 * units)), "wh": square.T.copy(), "b": bias, "wo": rng.uniform(-1, 1, units) * np.sqrt(6 / (units + 1)), "bo": np.zeros(1)}


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step (steps, rows, units) and what the backward pass needs."""
    rows, steps, _ = x.shape
    units = len(p["wo"])
    h, c, states, tape = np.zeros((rows, units)), np.zeros((rows, units)), [], []
    for t in range(steps):
        z = x[:, t] @ p["wx"] + h @ p["wh"] + p["b"]
        i, f, o = _sigmoid(z[:, :units]), _sigmoid(z[:, units : 2 * units]), _sigmoid(z[:, 3 * units :])
        g, m = np.tanh(z[:, 2 * units : 3 * units]), mask[:, t, None]
        new = f * c + i * g
        wave = np.tanh(new)
        tape.append((h, c, i, f, g, o, wave, m))
        h, c = np.where(m, o * wave, h), np.where(m, new, c)
        states.append(h)
    return np.stack(states), tape


def backward(p: dict[str, np.ndarray], x: np.ndarray, tape: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the layer, given those of the states after each step."""
    out = {k: np.zeros_like(p[k]) for k in ("wx", "wh", "b")}
    dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, g, o, wave, m = tape[t]
        dh = dh + d_states[t]
        live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
        d_new = live_h * o * (1 - wave * wave) + live_c
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_new * i * (1 - g * g), live_h * wave * o * (1 - o)], axis=1)
        out["wx"] += x[:, t].T @ dz
        out["wh"] += h.T @ dz
        out["b"] += dz.sum(axis=0)
        dh, dc = np.where(m, 0, dh) + dz @ p["wh"].T, np.where(m, 0, dc) + d_new * f
    return out


@dataclass
class Recurrent:
    params: dict[str, np.ndarray]
    every_step: bool
    mean: float
    scale: float
    history: list[tuple[int, float, float, float, float]]
    x_mean: np.ndarray | float = 0.0
    x_scale: np.ndarray | float = 1.0

    def _raw(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        x = (x - self.x_mean) / self.x_scale
        states, tape = forward(self.params, x, mask)
        used = states if self.every_step else states[-1:]
        return (used @ self.params["wo"] + self.params["bo"]).T, states, tape

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for standardised targets (rows, steps), or (rows, 1) for the last state."""
        out, states, tape = self._raw(x, mask)
        x = (x - self.x_mean) / self.x_scale
        counts = mask if self.every_step else np.ones_like(out, dtype=bool)
        n = max(int(counts.sum()), 1)
        error = np.where(counts, out - y, 0.0)
        d_out = 2 * error / n
        d_states = np.zeros_like(states)
        d_states[-d_out.shape[1] :] = d_out.T[:, :, None] * self.params["wo"]
        used = states[-d_out.shape[1] :]
        grads = backward(self.params, x, tape, d_states)
        grads |= {"wo": np.einsum("tr,tru->u", d_out.T, used), "bo": np.array([d_out.sum()])}
        return float((error * error).sum() / n), grads

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._raw(x, mask)[0] * self.scale + self.mean

    def losses(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Mean squared and mean absolute error, in the target's unit."""
        counts = mask if self.every_step else np.ones_like(y, dtype=bool)
        if not counts.any():
            return float("nan"), float("nan")
        e = np.concatenate([(self.predict(x[a : a + 256], mask[a : a + 256]) - y[a : a + 256])[counts[a : a + 256]] for a in range(0, len(x), 256)])
        return float((e * e).mean()), float(np.abs(e).mean())


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, every_step: bool, units: int = 64, epochs: int = 20, batch: int = 32, validate: float = 0.2, rate: float = 1e-3, seed: int = 42) -> Recurrent:
    cut = len(x) - int(len(x) * validate)
    known = y[:cut][mask[:cut]] if every_step else y[:cut]
    mean, scale = (float(known.mean()), float(known.std()) or 1.0) if known.size else (0.0, 1.0)
    model = Recurrent(initial(x.shape[2], units, seed), every_step, mean, scale, [])
    seen = x[:cut][mask[:cut]]
    if len(seen):
        spread = seen.std(axis=0)
        model.x_mean, model.x_scale = seen.mean(axis=0), np.where(spread > 0, spread, 1.0)
    rng, step = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(w) for k, w in model.params.items()} for _ in range(2))
    for epoch in range(1, epochs + 1):
        order = rng.permutation(cut)
        for at in range(0, cut, batch):
            rows, step = order[at : at + batch], step + 1
            _, grads = model.gradients(x[rows], mask[rows], (y[rows] - mean) / scale)
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
        model.history.append((epoch, *model.losses(x[:cut], mask[:cut], y[:cut]), *model.losses(x[cut:], mask[cut:], y[cut:])))
    return model


def _arrays(column) -> np.ndarray:
    return np.array([np.stack(r) for r in column], dtype=np.float64)


def _sample(rows: DataFrame, key: list[str], max_rows: int) -> pd.DataFrame:
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return rows.toPandas().sort_values(key, kind="stable", ignore_index=True)


def fit_windows(windows: DataFrame, key: tuple[str, ...] = ("mmsi", "voyage_id", "window_id"), max_rows: int = 20_000, **how) -> Recurrent | None:
    """From ``x`` and ``y`` of ``sequences.windows``; None without windows."""
    got = _sample(windows.select(*key, "x", "y"), list(key), max_rows)
    if got.empty:
        return None
    x = _arrays(got["x"])
    return train(x, np.ones(x.shape[:2], dtype=bool), got["y"].to_numpy(dtype=np.float64)[:, None], False, **how)


def fit_sequences(padded: DataFrame, max_rows: int = 2000, **how) -> Recurrent | None:
    """From ``length``, ``x`` and ``y`` of ``sequences.padded``; None without sequences."""
    got = _sample(padded.select("segment_id", "length", "x", "y"), ["segment_id"], max_rows)
    if got.empty:
        return None
    x, y = _arrays(got["x"]), np.array(got["y"].tolist(), dtype=np.float64)
    return train(x, _steps(got["length"].to_numpy(), x.shape[1]), y, True, **how)


def _steps(length: np.ndarray, steps: int) -> np.ndarray:
    """True where a step is not padding, which comes first."""
    return np.arange(steps)[None, :] >= steps - np.asarray(length)[:, None]


def _stacked(xs: pd.Series) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Sequences of one length together, 256 at a time, and their places."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(xs):
        by.setdefault(len(x), []).append(i)
    for at in by.values():
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            yield np.stack([np.stack(xs.iloc[i]) for i in part]).astype(np.float64), part


def predict(rows: DataFrame, model: Recurrent) -> DataFrame:
    """Adds ``prediction``: a double for windows, an array with one per step, null in the padding, for sequences."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def windowed(xs: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=range(len(xs)))
        for x, at in _stacked(xs):
            out.iloc[at] = sent.value.predict(x, np.ones(x.shape[:2], dtype=bool))[:, 0]
        return out

    def stepwise(xs: pd.Series, lengths: pd.Series) -> pd.Series:
        out, sizes = [None] * len(xs), lengths.to_numpy()
        for x, at in _stacked(xs):
            mask = _steps(sizes[at], x.shape[1])
            for i, row, known in zip(at, sent.value.predict(x, mask).tolist(), mask, strict=True):
                out[i] = [p if m else None for p, m in zip(row, known, strict=True)]
        return pd.Series(out)

    made = F.pandas_udf(stepwise, "array<double>")("x", "length") if model.every_step else F.pandas_udf(windowed, "double")("x")
    return rows.withColumn("prediction", made)


def steps_of(predicted: DataFrame) -> DataFrame:
    """(segment_id, step, y, prediction) of the steps of predicted sequences, without the padding."""
    both = predicted.select("segment_id", F.posexplode(F.arrays_zip("y", "prediction")).alias("step", "s"))
    return both.select("segment_id", "step", F.col("s.y").cast("double").alias("y"), F.col("s.prediction").alias("prediction")).where("prediction is not null")


def history(spark: SparkSession, model: Recurrent | None) -> DataFrame:
    """Loss and mean absolute error by epoch, in training and in validation."""
    return spark.createDataFrame(model.history if model else [], "epoch int, loss double, mae double, val_loss double, val_mae double")
