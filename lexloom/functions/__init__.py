"""Column functions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(kind: str):
    """A Pandas UDF that is made when first used, so that importing a module needs no session."""

    def wrap(function):
        @functools.wraps(function)
        def call(*cols) -> Column:
            return F.pandas_udf(function, kind)(*[F.col(c) if isinstance(c, str) else c for c in cols])

        return call

    return wrap
