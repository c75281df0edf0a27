"""Incremental ingestion and live status on Structured Streaming (O119, O120)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauselake.operators.chunks import chunk_pages
from clauselake.operators.embedding import with_hashed_embedding
from clauselake.operators.pages import resolve_page_text
from clauselake.operators.status import current_status
from clauselake.plans.stored import stored
from clauselake.sources.keyed_log import KeyedLog
from clauselake.sources.tables import latest_by_key, upsert

PAGE_KEYS = ["document_id", "page_number"]
ARRIVAL = "arrival"


def index_documents(pages: DataFrame, layout_mode: str = "scanned") -> DataFrame:
    """Pages -> chunks with sections, fingerprints and vectors; the batch and the stream share it."""
    return with_hashed_embedding(chunk_pages(resolve_page_text(pages, layout_mode)))


def stream_pages(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream of arriving page tables; ``arrival`` orders the versions of a page."""
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select("*", arrival.alias(ARRIVAL))


def ingest_stream(
    pages: DataFrame, pages_path: str, chunks_path: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """O119: keep the chunk table equal to a batch run over all pages seen so far.

    Each micro-batch first appends its pages by (document, page), then rebuilds
    the chunks of the touched documents from all their stored pages, because a
    section crosses pages, and replaces them by document. Both tables are keyed
    logs: a batch writes what it touches and no more, and one that runs again,
    also after it was lost between the two writes, leaves the same tables. Of a
    page that comes twice in one batch the last to arrive counts.
    """
    page_log, chunk_log = ingested_tables(pages_path, chunks_path, buckets)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.col(ARRIVAL) if ARRIVAL in batch.columns else F.xxhash64(*batch.columns)
        latest = latest_by_key(batch, PAGE_KEYS, order).drop(ARRIVAL)
        page_log.append(latest, page_log.first_commit(spark, checkpoint) + batch_id)
        touched = batch.select("document_id").distinct()
        pages_of = stored(page_log.read(spark, touched), "touched-pages")  # read by two steps of the sections
        fresh = stored(index_documents(pages_of), "touched-chunks")  # its keys are read before its rows are written
        chunk_log.append(fresh, chunk_log.first_commit(spark, checkpoint) + batch_id, gone=touched)
        page_log.compact(spark)
        chunk_log.compact(spark)

    return (
        pages.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested_tables(pages_path: str, chunks_path: str, buckets: int = 64) -> tuple[KeyedLog, KeyedLog]:
    """The page and chunk tables that ``ingest_stream`` keeps."""
    return (
        KeyedLog(pages_path, tuple(PAGE_KEYS), ("document_id",), buckets),
        KeyedLog(chunks_path, ("document_id",), (), buckets),
    )


def status_stream(events: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """O120: current status per document, kept in a table keyed by document.

    Keyed state without event time; each micro-batch writes only the documents whose status changed.
    """

    def apply(changed: DataFrame, batch_id: int) -> None:
        upsert(changed, path, ["document_id"], buckets)

    return (
        current_status(events).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
