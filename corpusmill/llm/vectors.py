"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has a component, and all of them are finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) <= 1.7976931348623157e308, F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & ~F.exists(v, F.isnan), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def block(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int")


def every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
