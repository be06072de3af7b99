"""Name similarity: Ratcliff-Obershelp ratio, which Catalyst has no expression for.

Pairs reach the function in Arrow batches and only after a join has found them; a pair that
repeats within a batch is computed once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallymark.functions.scalars import norm_bank


def _ratio_udf():
    # Defined here so that the function travels to the workers by value: they do not need this
    # package on their path.
    def ratio_batch(a, b):
        from difflib import SequenceMatcher

        import pandas as pd

        seen = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in seen:
                seen[pair] = SequenceMatcher(None, *pair).ratio()
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    ratio_batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio_batch, DoubleType())


ratio = _ratio_udf()


def bank_similarity(detected: Column, registry: Column) -> Column:
    """Argument order matters: the detected name comes first."""
    return ratio(norm_bank(detected), norm_bank(registry))
