"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, flush: int = 0, post: tuple = (), mode: str = "overwrite") -> None:
    """Parquet, after the ``post`` functions (DataFrame to DataFrame) in order; files of at most ``flush`` rows."""
    for f in post:
        df = df.transform(f)
    df.write.mode(mode).option("maxRecordsPerFile", flush).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_episodes(steps: DataFrame, path: str) -> None:
    """One JSON object an episode, its steps in order."""
    fields = [c for c in steps.columns if c != "episode_id"]
    whole = steps.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("step", *[c for c in fields if c != "step"])), lambda a, b: (a["step"] - b["step"]).cast("int")).alias("steps"))
    whole.write.mode("overwrite").json(path)


def prediction_rows(df: DataFrame, keys: str, predictions: str) -> DataFrame:
    """(key, prediction) of parallel lists."""
    return df.select(F.inline(F.arrays_zip(F.col(keys).alias("key"), F.col(predictions).alias("prediction"))))
