"""The seam to media: a reader of frames or samples is a plain class; Spark calls one for each file in a task.

No decoder is part of this package. A reader is given by its class, so that tasks open their own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.ship import ship


class FrameReader(Protocol):
    """Frames of one file in order of time."""

    def __init__(self, path: str) -> None: ...

    def frames(self, times: Iterable[float]) -> Iterator[tuple[float, bytes]]:
        """(time on screen, pixels) of the frame shown at each time; times past the end give nothing."""


def fetch(probes: DataFrame, reader: type, path: str = "path", time: str = "time") -> DataFrame:
    """(path, time, shown_at, pixels) of the probes (path, time): each file is opened once, in one task."""
    ship(probes.sparkSession)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        own, times = pdf[path].iloc[0], sorted(pdf[time])
        source = reader(own)
        got = [(own, t, *f) for t in times for f in source.frames([t])]
        return pd.DataFrame(got, columns=["path", "time", "shown_at", "pixels"])

    return probes.groupBy(path).applyInPandas(group, "path string, time double, shown_at double, pixels binary")


#: Bytes at each end of a file that its key covers, and the key's size.
KEY_CHUNK, KEY_SIZE = 1 << 20, 16


def content_keys(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, key) of files that the workers can open: a digest of the size and of the first and last KEY_CHUNK bytes.

    It follows the content, not the name; null for a file that cannot be read. No file is read as a whole.
    """

    def key(name: str) -> str | None:
        digest = hashlib.blake2b(digest_size=KEY_SIZE)
        try:
            with open(name, "rb") as f:
                size = os.fstat(f.fileno()).st_size
                digest.update(size.to_bytes(8, "little") + f.read(KEY_CHUNK))
                f.seek(max(size - KEY_CHUNK, 0))
                digest.update(f.read(KEY_CHUNK))
        except OSError:
            return None
        return digest.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf[path], "key": [None if x is None else key(x) for x in pdf[path]]})

    return paths.select(path).mapInPandas(run, "path string, key string")
