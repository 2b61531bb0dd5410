"""Files dropped into a folder, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import typed
from ..sources.xlsx import cells_of_binary_files


def workbook_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Cells of every workbook that appears in folder, each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return cells_of_binary_files(files.option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", files_per_batch).load(folder))


def write_typed_cells(cells: DataFrame, out: str, checkpoint: str):  # noqa: ANN201
    """Typed cells as Parquet by file; restarts where it stopped, each batch exactly once."""
    return typed(cells).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("file").trigger(availableNow=True).start()


def type_counts(cells: DataFrame) -> DataFrame:
    """How many cells of each semantic type each file has, kept up to date."""
    return typed(cells).groupBy("file", "sheet", "semantic").agg(F.count("*").alias("n"))
