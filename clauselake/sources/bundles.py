"""Many documents in few text files, with an index of where each stands.

A bundle is a plain UTF-8 file of about ``bundle_bytes``; the documents in it follow each other in the order of their
keys, each value ended by a line break. The number of files follows the size of the texts, not the number of documents.
A document of many rows (a report of lines) is cut into pieces that spread over the bundles. The index has one row per
piece: key, piece number, file, byte offset and length, so a reader fetches a document without any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.plans.once import let
from clauselake.session import ensure_checkpoint_dir

BUNDLE_BYTES = 16 << 20
BUNDLE_IN_PATH = r"bundle=(\d+)/"


def write_bundles(
    rows: DataFrame, path: str, key: str, text: str, order: list[str] | None = None, piece: Column | None = None,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write ``path/files`` and ``path/index``; the index: ``(key, piece, file, offset, length)``.

    ``order`` sorts the rows of a key. ``piece``, a whole number that never falls along that order, says which rows stay
    together; without it a key is one piece. A null text is written as an empty one. Rows that tie in key and order are
    of one piece and stand in any order. ``rows`` runs twice, once for the lengths and once for the texts, and has to give
    the same rows both times.
    """
    order = order or []
    number = F.lit(0) if piece is None else piece
    placed = rows.select(
        F.col(key).alias("key"), number.cast("bigint").alias("piece"), F.struct(F.lit(0).alias("_"), *order).alias("order"),
        F.coalesce(text, F.lit("")).alias("value"),
    )
    ensure_checkpoint_dir(rows.sparkSession)
    lengths = placed.groupBy("key", "piece").agg(F.sum(F.octet_length("value").cast("bigint") + 1).alias("length")).checkpoint()
    size = lengths.agg(F.sum("length")).first()[0] or 0  # one number
    bundles = max(1, -(-size // bundle_bytes))
    bundle = F.pmod(F.xxhash64("key", "piece"), F.lit(bundles)).alias("bundle")
    sorted_rows = placed.select("*", bundle).repartition(bundles, "bundle").sortWithinPartitions("bundle", "key", "piece", "order")
    written = sorted_rows.select("bundle", "value").write.mode("overwrite").partitionBy("bundle")
    written.option("lineSep", "\n").text(f"{path}/files")

    lengths = lengths.select("*", bundle)
    before = Window.partitionBy("bundle").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    index = lengths.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    files = _files(rows.sparkSession, path).select("file", F.regexp_extract("file", BUNDLE_IN_PATH, 1).cast("bigint").alias("bundle"))
    found = index.join(files, "bundle").select(F.col("key").alias(key), "piece", "file", "offset", "length")
    found.write.mode("overwrite").parquet(f"{path}/index")
    return rows.sparkSession.read.schema(found.schema).parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str, index: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, piece, text)`` of the pieces that ``index``, whole or filtered, names.

    Only files with a wanted piece are joined; a file is cut where it is read. Its bytes are bound once, since a column
    that a lambda reads is copied out of its row for every piece.
    """
    wanted = index.groupBy("file").agg(F.collect_list(F.struct(F.col(key).alias("key"), "piece", "offset", "length")).alias("wanted"))
    content = _files(spark, path, "content").join(wanted, "file")

    def cut(file: Column, entry: Column) -> Column:
        part = F.substring(file, (entry["offset"] + 1).cast("int"), (entry["length"] - 1).cast("int"))
        return F.struct(entry["key"].alias(key), entry["piece"].alias("piece"), part.cast("string").alias(text))

    pieces = let(F.col("content"), lambda file: F.transform("wanted", lambda entry: cut(file, entry)))
    return content.select(F.inline(pieces))


def read_document(spark: SparkSession, path: str, index: DataFrame, key: str, value, text: str) -> DataFrame:
    """The pieces of one document in order: its index rows name the only files that are opened."""
    own = index.filter(F.col(key) == F.lit(value))
    names = [row["file"] for row in own.select("file").distinct().collect()]  # one per piece of one document at most
    if not names:
        return read_bundles(spark, path, own, key, text)
    content = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), "content")
    part = F.substring("content", (F.col("offset") + 1).cast("int"), (F.col("length") - 1).cast("int"))
    return own.join(content, "file").select(key, "piece", part.cast("string").alias(text)).orderBy("piece")


def _files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Paths of the bundles; their bytes are read only if asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/files")
    return found.select(F.col("path").alias("file"), *columns)
