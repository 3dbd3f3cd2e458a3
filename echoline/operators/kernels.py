"""NumPy kernels as Arrow-batched column functions over array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Samples of a column that are stacked at once.
STACK = 2**20


def by_length(*columns: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers of equal lengths, with their signals stacked, ``STACK`` samples at once; null and empty signals are left out."""
    sizes: dict[tuple[int, ...], list[int]] = {}
    for i, row in enumerate(zip(*columns, strict=True)):
        if all(x is not None and len(x) for x in row):
            sizes.setdefault(tuple(map(len, row)), []).append(i)
    for lengths, all_rows in sizes.items():
        most = max(1, STACK // max(lengths))
        for k in range(0, len(all_rows), most):
            rows = all_rows[k : k + most]
            yield np.array(rows), [np.stack([np.asarray(c.iloc[i], float) for i in rows]) for c in columns]


def array_kernel(f: Callable[..., np.ndarray], *columns: Column) -> Column:
    """``f`` on stacked signals, returning an array a row; null where a signal is null or empty."""

    def run(*series: pd.Series) -> pd.Series:
        out: list[object] = [None] * len(series[0])
        for rows, signals in by_length(*series):
            for i, y in zip(rows, f(*signals), strict=True):
                out[i] = y.reshape(-1)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(*columns)


def struct_kernel(f: Callable[..., dict[str, np.ndarray]], fields: str, *columns: Column) -> Column:
    """``f`` on stacked signals, returning named columns of doubles (or arrays, as ``fields`` says)."""
    names = [part.split(":")[0].strip() for part in fields.split(",")]

    def run(*series: pd.Series) -> pd.DataFrame:
        out = {n: [None] * len(series[0]) for n in names}
        for rows, signals in by_length(*series):
            found = f(*signals)
            for n in names:
                for i, y in zip(rows, found[n], strict=True):
                    out[n][i] = y
        return pd.DataFrame(out)

    return F.pandas_udf(run, f"struct<{fields}>")(*columns)
