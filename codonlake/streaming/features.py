"""Features of a stream of transcripts. The expressions keep no state, so they are the same as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codonlake.functions import features
from codonlake.sources.readers import TRANSCRIPTS


def transcript_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(TRANSCRIPTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def feature_stream(rows: DataFrame, species: str = "human", groups: list[str] | None = None) -> DataFrame:
    return features.matrix(rows, species, groups)


def write_features(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet; takes what is there, then ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
