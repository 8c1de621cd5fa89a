"""Users' own functions in queries: samplers, table functions, and jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def sampler(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., Column]:
    """A vectorised function of z, y, x arrays as a column function."""

    @F.pandas_udf("double")
    def run(z: pd.Series, y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(z.to_numpy(), y.to_numpy(), x.to_numpy()), float))

    return run


@F.udtf(returnType="z int, y int, x int, v int")
class RawVoxels:
    """Table function ``raw_voxels(data, nz, ny, nx)``: the non-zero voxels of a raw volume's bytes."""

    def eval(self, data: bytes, nz: int, ny: int, nx: int) -> Iterator[tuple]:
        if len(data) != nz * ny * nx:
            raise ValueError(f"{len(data)} bytes where {nz * ny * nx} are expected")
        for k in np.flatnonzero(np.frombuffer(data, np.uint8)):
            yield int(k) // (ny * nx), int(k) // nx % ny, int(k) % nx, data[int(k)]


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], at_once: int = 8) -> list:
    """Results of jobs (such as traces from many seeds) run by so many threads of the driver, each in a scheduler pool of its own."""

    def one(k: int) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"job{k % at_once}")
        return jobs[k]()

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, range(len(jobs))))
