"""The corpus pipeline as a registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
