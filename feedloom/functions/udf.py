"""Arrow UDFs that can be declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a call gets: their parsed forms and results are in memory at once, however many rows Arrow batches hold.
PIECE = 200


def arrow_udf(returns: str, once: bool = False) -> Callable:
    """Like pandas_udf, but the return type (DDL) is parsed when a column is made of it, and f gets ``PIECE`` rows at a time.

    ``once``: the optimizer may not evaluate it again where its result is filtered (it counts as nondeterministic)."""
    result = pd.DataFrame if returns.startswith("struct<") else pd.Series

    def wrap(f: Callable) -> Callable[..., Column]:
        def one(batches):
            for column in batches:
                for at in range(0, len(column), PIECE):
                    yield f(column.iloc[at : at + PIECE])

        def several(batches):
            for columns in batches:
                for at in range(0, len(columns[0]), PIECE):
                    yield f(*[c.iloc[at : at + PIECE] for c in columns])

        one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[result]}
        several.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[result]}

        @functools.wraps(f, updated=())
        def column(*args) -> Column:
            udf = F.pandas_udf(one if len(args) == 1 else several, returns)
            return (udf.asNondeterministic() if once else udf)(*args)

        return column

    return wrap
