"""Ingest as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folia.sources.ingest import hashed, ingest_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, *, once: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Write a new generation of the library whenever article files arrive at source.

    A batch's own files are read, once; those of earlier generations keep their place. Contents
    are compared, so that a file seen twice, or a batch run again after a failure, changes
    nothing. once: handle what is there, then stop.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.esx").option("recursiveFileLookup", True).load(source)

    def arrived(batch: DataFrame, _: int) -> None:
        if batch.select("path").limit(1).count():
            ingest_files(batch.sparkSession, hashed(batch.filter("length > 0")), target, whole=False)

    writer = files.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
