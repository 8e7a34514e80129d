"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise
    as it is, for a shuffled join. Counting stops at the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
