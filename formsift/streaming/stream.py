"""The same pipeline over a stream of documents.

Extraction is stateless and narrow, so it runs unchanged on a stream; counts by
event time close with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formsift.operators.analytics import document_analytics
from formsift.plans.pipeline import extract


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, at timestamp", kind: str = "parquet", files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def extract_stream(docs: DataFrame, **plug_ins) -> DataFrame:
    return extract(docs, **plug_ins)


def windowed_counts(extracted: DataFrame, at: str = "at", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Entities by time window and type; documents later than `late` are left out."""
    rows = extracted.withWatermark(at, late).select(at, F.explode("entities").alias("e"))
    return rows.groupBy(F.window(at, width), F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("entities"))


def write_stream(extracted: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write entities to Parquet; per-document counts go beside them. Each batch has
    a folder of its own by number, and a batch that is run again replaces it, so
    each document is there once."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{path}/entities/batch={number}")
        document_analytics(df).write.mode("overwrite").parquet(f"{path}/analytics/batch={number}")
        df.unpersist()

    writer = extracted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
