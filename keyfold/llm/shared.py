"""Helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are made Python objects at a time; an Arrow batch may hold 64 MB of texts.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset (local mode, tests), a folder of this
    machine is made and set, as driver and executors are then one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keyfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what is read again survives the loss of any executor, and its size on
    disk is known to the planner, which then broadcasts it only below the session's limit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As ``mapInPandas``, but the frames are short slices of the Arrow batches, so that a worker never holds a whole batch of texts as Python objects beside its Arrow form."""
    declared = StructType.fromDDL(schema)
    arrow = to_arrow_schema(declared)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE).to_pandas(integer_object_nulls=True)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(over, declared)
