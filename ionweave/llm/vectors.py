"""What the operators on vectors share: which rows take part, and their components as whole numbers.

A component x becomes floor(256 * x). Rows take part if the vector is not null, is as long as
most vectors are (ties: the shorter length) and holds neither null nor a component that is not
finite or beyond ``LARGEST``: so sums of squares and products over ``MOST_PARTS`` components fit
64 bits, and no result can overflow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: |x| of a component, and components of a vector, at most.
LARGEST, MOST_PARTS = float(1 << 16), 1 << 12


def whole(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has at least one component and only finite ones."""
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)))
    return df.where(F.col(column).isNotNull() & F.size(column).between(1, MOST_PARTS) & fine)


def kept(df: DataFrame, column: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows that take part, and how long their vectors are (0: there are none).

    ``multiple``: only lengths that it divides count.
    """
    fine = whole(df, column).where(F.size(column) % multiple == 0)
    lengths = fine.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = lengths["n"] if lengths else 0
    return fine.where(F.size(column) == length), length


def integers(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64).reshape(-1, length)
