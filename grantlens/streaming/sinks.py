"""Writing micro-batches so that a replay leaves no duplicates, and reading them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The column that partitions a target by the micro-batch that wrote a row.
BATCH = "batch_id"


def write_batch(batch: DataFrame, path: str, batch_id: int, kind: str = "json") -> None:
    """One micro-batch under its own folder of the target. The same batch once more takes the place of what it wrote before."""
    batch.write.mode("overwrite").format(kind).save(f"{path}/{BATCH}={batch_id}")


def split_sink(targets: dict[str, Column], kind: str = "json", drop: dict[str, tuple[str, ...]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows go to every target (path) whose condition they fulfil, without the columns listed for it.

    The batch is held while its targets are written, so its source is read once. An unknown (null) condition keeps a row out.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for path, condition in targets.items():
                write_batch(held.filter(condition).drop(*(drop or {}).get(path, ())), path, batch_id, kind)
        finally:
            held.unpersist()

    return write


def read_batches(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """All rows of a target with the batch that wrote each one; a target that no batch has reached yet is empty."""
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*shape.fields]).add(BATCH, "long")
    try:
        return spark.read.schema(whole).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
