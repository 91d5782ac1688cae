"""Point operators on frames in the long layout: pixels(image_id, [y, x,] r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.functions import colour as C


def through(df: DataFrame, steps: list) -> DataFrame:
    """df with its colours put through steps, a projection each: the optimizer keeps them apart where a step uses a colour twice, and all run in one stage's code."""
    for step in steps:
        df = df.withColumns(dict(zip("rgb", step(tuple(F.col(c) for c in "rgb")), strict=True)))
    return df


def grade(df: DataFrame, p: dict[str, float]) -> DataFrame:
    return through(df, C.grade_steps(p))


def tone(df: DataFrame, p: dict[str, float]) -> DataFrame:
    return through(df, C.tone_steps(p))
