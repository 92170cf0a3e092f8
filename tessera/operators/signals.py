"""Array operators over samples and small images: spectra, peaks, activity, thresholds. Arrow-batched numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ship import ship


def spectrum(samples: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Log magnitudes log(1 + |X|) of Hann-windowed frames (frame x bin), in single precision; none for fewer samples than a frame."""
    x = np.asarray(samples, np.float32)
    if len(x) < size:
        return np.zeros((0, size // 2 + 1), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.log1p(np.abs(np.fft.rfft(frames * np.hanning(size).astype(np.float32), axis=1))).astype(np.float32)


def _sliding_max(a: np.ndarray, width: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (width // 2, width - 1 - width // 2)
    wide = np.pad(a, pad, constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(wide, width, axis=axis).max(-1)


def peaks(grid: np.ndarray, floor: float, time: int = 9, freq: int = 15) -> list[tuple[int, int, float]]:
    """(frame, bin, value) of cells above the floor that no cell of their neighbourhood exceeds."""
    if not grid.size:
        return []
    top = _sliding_max(_sliding_max(grid, time, 0), freq, 1)
    return [(int(t), int(f), float(grid[t, f])) for t, f in np.argwhere((grid >= top) & (grid > floor))]


def band_share(samples: np.ndarray, rate: int, lo: float, hi: float) -> float:
    """The part of the energy that lies between two frequencies; 0 for silence."""
    x = np.asarray(samples, np.float64)
    energy = np.abs(np.fft.rfft(x)) ** 2
    at = np.fft.rfftfreq(len(x), 1 / rate) if len(x) else np.zeros(0)
    total = energy.sum()
    return float(energy[(at >= lo) & (at <= hi)].sum() / total) if total else 0.0


def otsu(values: np.ndarray) -> int:
    """The threshold of 0-255 values that parts them best (the lowest of equals)."""
    n = np.bincount(np.asarray(values, np.int64), minlength=256).astype(np.float64)
    below, level = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (level / below - (level[-1] - level) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def per_row(df: DataFrame, column: str, name: str, kind: str, f: Callable) -> DataFrame:
    """df with f of an array column; null stays null."""
    ship(df.sparkSession)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(np.asarray(v)) for v in s])

    return df.withColumn(name, run(F.col(column)))


def activity(df: DataFrame, keys: Sequence[str], at: str, active: Column, close: float, least: float) -> DataFrame:
    """Spans of active rows: pauses of no more than `close` are bridged, spans shorter than `least` dropped."""
    on = df.where(active)
    w = Window.partitionBy(*keys).orderBy(at)
    on = on.withColumn("__n", F.coalesce(F.col(at) - F.lag(at).over(w) > close, F.lit(False)).cast("int"))
    on = on.withColumn("__i", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = on.groupBy(*keys, "__i").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows")).drop("__i")
    return out.where(F.col("end") - F.col("start") >= least)


def overlapping_rows(boxes: Column) -> Column:
    """How many text rows an array of struct<y0,y1> has: boxes that overlap by half of the lower one share a row. A fold of the array in y order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1.0e18).alias("y0"), F.lit(-1.0e18).alias("y1"))

    def step(s: Column, b: Column) -> Column:
        common = F.least(s["y1"], b["y1"].cast("double")) - F.greatest(s["y0"], b["y0"].cast("double"))
        same = 2 * common >= F.least(s["y1"] - s["y0"], b["y1"].cast("double") - b["y0"].cast("double"))
        return F.struct(
            (s["n"] + F.when(same, 0).otherwise(1)).alias("n"),
            F.when(same, F.least(s["y0"], b["y0"].cast("double"))).otherwise(b["y0"].cast("double")).alias("y0"),
            F.when(same, F.greatest(s["y1"], b["y1"].cast("double"))).otherwise(b["y1"].cast("double")).alias("y1"),
        )

    return F.aggregate(F.array_sort(boxes), start, step, lambda s: s["n"])
