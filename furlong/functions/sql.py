"""Functions for SQL that Spark's own cannot say: ``register(spark)`` makes them callable in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import DoubleType

#: Entities of one field at most: of 24, the ordered threes are 12,144 rows.
MOST = 24


class SelectionGrid:
    """``selection_grid(entities, size, ordered)``: a row (selection) for each choice of ``size`` of the entities, in ascending order, or
    in every order. Null entities are no entities and repeated ones count once; a null or too short list has no rows. More
    than MOST entities are refused."""

    def eval(self, entities: list, size: int, ordered: bool) -> Iterator[tuple]:
        if entities is None or size is None:
            return
        own = sorted({e for e in entities if e is not None})
        if len(own) > MOST:
            raise ValueError(f"more than {MOST} entities in a field")
        for choice in (permutations if ordered else combinations)(own, size):
            yield ([*choice],)


def trend(x: pd.Series, y: pd.Series) -> float:
    """``ols_trend(x, y)``: the least-squares slope of y on x over the group's pairs without a null; null where x does not spread."""
    ok = x.notna() & y.notna()
    x, y = x[ok].astype(float), y[ok].astype(float)
    if len(x) < 2:
        return None
    x = x - x.mean()
    spread = float((x * x).sum())
    return float((x * (y - y.mean())).sum() / spread) if spread > 0 else None


def register(spark: SparkSession) -> None:
    """``selection_grid`` as a table function, ``ols_trend`` as an aggregate. A group of an aggregate is held by one task, so it is for
    groups that are bounded by nature: an entity's starts, a contest's entries."""
    spark.udtf.register("selection_grid", F.udtf(SelectionGrid, returnType="selection array<long>", useArrow=True))
    spark.udf.register("ols_trend", F.pandas_udf(trend, returnType=DoubleType()))
