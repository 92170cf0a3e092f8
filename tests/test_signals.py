"""Array operators and the media seam."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import folds, signals
from tessera.sources import media


def test_spectrum_and_peaks():
    t = np.arange(4096) / 4096
    grid = signals.spectrum(np.sin(2 * np.pi * 64 * 16 * t / 4), 256, 128)
    assert grid.shape == (31, 129) and abs(int(grid[5].argmax()) - 16) <= 1
    assert signals.spectrum(np.zeros(5), 256).shape == (0, 129) and signals.peaks(np.zeros((0, 4)), 0.1) == []
    spot = np.zeros((9, 9))
    spot[4, 5] = 2
    assert signals.peaks(spot, 0.1, 3, 3) == [(4, 5, 2.0)]


def test_band_and_otsu():
    t = np.arange(1600) / 16000
    assert signals.band_share(np.sin(2 * np.pi * 1000 * t), 16000, 300, 3400) > 0.99 and signals.band_share(np.zeros(8), 16000, 1, 2) == 0
    assert 10 <= signals.otsu(np.array([10] * 50 + [200] * 50)) < 200


def test_rows_of_boxes(spark):
    boxes = [[(0.0, 10.0), (2.0, 11.0), (20.0, 30.0)], []]
    df = spark.createDataFrame([(b,) for b in boxes], "boxes array<struct<y0:double,y1:double>>")
    assert [r.n for r in df.select(signals.overlapping_rows(F.col("boxes")).alias("n")).collect()] == [2, 0]


def test_more_folds():
    assert [r["id"] for r in folds.admit(10)([{"id": k, "size": s} for k, s in enumerate((6, 7, 4))])] == [0, 2]
    rows = [{"at": a} for a in range(100)]
    drawn = [r["at"] for r in folds.draw(4, 10, 64, 1)(rows)]
    assert drawn == [r["at"] for r in folds.draw(4, 10, 64, 1)(rows)] and all(b - a >= 10 for a, b in zip(drawn, drawn[1:], strict=False))
    spans = [{"start": 0, "end": 5, "x": 0}, {"start": 3, "end": 9, "x": 1}, {"start": 3, "end": 9, "x": 50}]
    assert [g["n_rows"] for g in folds.batches(5)(spans)] == [2, 1]


class Fake:
    def __init__(self, path):
        self.path = path

    def frames(self, times):
        return ((round(t), self.path.encode()) for t in times if t < 10)


def test_media_seam(spark):
    probes = spark.createDataFrame([("a", 1.2), ("a", 50.0), ("b", 3.0)], "path string, time double")
    got = sorted((r.path, r.time, r.shown_at) for r in media.fetch(probes, Fake).collect())
    assert got == [("a", 1.2, 1.0), ("b", 3.0, 3.0)]
