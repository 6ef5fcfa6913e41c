"""Stage tables of the operators, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossier.sinks.stage import new_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, compactly, and read it back: lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text) -> str:
    return text or ""
