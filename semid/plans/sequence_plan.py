"""A declared preprocessing of sequence tables, built into one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semid.operators.sequences import longer_than, pad_or_trim, remove_token


@dataclass(frozen=True)
class SequencePlan:
    """What a sequence table goes through, in order: rename and project, decode bytes, cast, drop short or empty rows, remove the unknown token, extra steps, pad or trim."""

    id_col: str
    rename: dict[str, str] = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    least: int = 1
    length: int | None = None
    padding: int = 0
    unknown: int | None = None
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def build(self, df: DataFrame) -> DataFrame:
        if self.rename:
            df = df.select(*[F.col(a).alias(b) for a, b in self.rename.items() if a in df.columns])
        if self.keep:
            df = df.select(*[c for c in df.columns if c in self.keep or c == self.id_col])
        for name, kind in df.dtypes:
            if kind == "binary":
                df = df.withColumn(name, F.decode(name, "UTF-8"))
        seqs = [c for c, kind in df.dtypes if kind.startswith("array") and c != self.id_col]
        for c in df.columns:
            if c != self.id_col and (c in seqs or c in self.types):
                kind = self.types.get(c, "bigint")
                df = df.withColumn(c, F.col(c).cast(f"array<{kind}>") if c in seqs else F.array(F.col(c).cast(kind)))
        df = longer_than(df, seqs, max(1, self.least))
        for c in seqs:
            df = df.withColumn(c, remove_token(F.col(c), self.unknown))
        for step in self.steps:
            df = df.transform(step)
        if self.length:
            for c in seqs:
                df = df.withColumn(c, pad_or_trim(F.col(c), self.length, self.padding))
        return df
