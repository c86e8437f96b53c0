"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from capsonde.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read from there.

    Cuts lineage, survives lost executors, keeps columns apart, and gives the optimizer its size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], n: int) -> list[str]:
    """n column names that differ from those taken, in any case."""
    lower = {c.lower() for c in taken}
    return [c for c in (f"helper_{i}" for i in range(len(taken) + n)) if c not in lower][:n]
