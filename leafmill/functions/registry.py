"""SQL functions of the page model: an aggregate, a table function and scalar ones, by name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leafmill.functions import numerals

MAD_SCALE = 1.4826


def robust_mad(values: pd.Series) -> float:
    """Scaled median of the absolute distances from the median; null without values."""
    v = values.dropna().to_numpy(float)
    return float(MAD_SCALE * np.median(np.abs(v - np.median(v)))) if len(v) else float("nan")


class DigitRuns:
    """(number, start, stop) of every digit run of at most six digits of a text, full-width ones included."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int]]:
        for m in re.finditer("[0-9０-９]+", text or ""):
            if len(m[0]) <= numerals.LONGEST_NUMERAL:
                yield int(m[0]), m.start(), m.end()


def register(spark: SparkSession) -> None:
    """Makes robust_mad, likeness and the table function digit_runs known to SQL."""
    spark.udf.register("robust_mad", _aggregate())
    spark.udf.register("likeness", numerals.likeness)
    spark.udtf.register("digit_runs", F.udtf(DigitRuns, returnType="number long, start int, stop int"))


def _aggregate():
    @F.pandas_udf(DoubleType())
    def mad(values: pd.Series) -> float:
        return robust_mad(values)

    return mad
