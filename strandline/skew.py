"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_by_weight(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``; ``weight`` counts the key's rows of ``left``.

    Keys with more than ``total / HOT_SHARE`` rows of ``left``, of which there are fewer than ``HOT_SHARE``,
    are joined by broadcast, so their rows are not shuffled at all.  The other keys are shuffled; each holds at most
    a thousandth of the rows, and where that is still much the adaptive skew join splits its partition.
    """
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(right.filter(F.col(weight) > limit))
    cold = right.filter(F.col(weight) <= limit)
    return left.join(hot, key).unionByName(left.join(F.broadcast(right.filter(F.col(weight) > limit).select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key))
