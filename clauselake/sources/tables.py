"""Tables: scans, keyed upsert, intake and nested JSON sources (O1, O2, O4, O5, O9, O29, O122)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.catalog import DOCUMENT_HEADER, FACT_STATUSES, MAX_DOCUMENT_BYTES
from clauselake.functions.text import is_blank
from clauselake.plans.once import compute_once
from clauselake.session import ensure_checkpoint_dir

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

EVIDENCE_SCHEMA = (
    "evidence_id string, policy_id string, document_id string, page_number int, chunk_id string, section_name string, "
    "clause_number string, quoted_text string, retrieval_score double, ocr_confidence double, source_type string"
)
PAGE_SCHEMA = (
    "policy_id string, document_id string, page_number int, native_text string, ocr_text string, ocr_confidence double, "
    "regions array<struct<kind:string,text:string,order:int>>"
)
BUNDLE_SCHEMA = (
    "policy struct<policy_id:string,seguradora:string,vigencia_inicio:string,vigencia_fim:string,fonte_documentos:string>, "
    "documents array<struct<document_id:string,policy_id:string,nome_fonte:string>>, "
    "evidences array<struct<evidence_id:string,policy_id:string,document_id:string,page_number:int,chunk_id:string,"
    "section_name:string,clause_number:string,quoted_text:string,retrieval_score:double,ocr_confidence:double,"
    "source_type:string>>, "
    "llm_output array<struct<field_code:string,status:string,value:string,confidence:double,evidence_ids:array<string>,"
    "requires_human_review:boolean>>"
)
REFERENCE_SET_SCHEMA = (
    "reference_version string, oq_02 string, cases array<struct<case_id:string,policy_id:string,"
    "chunks:array<struct<chunk_id:string,page_number:int,text:string>>,"
    "expected_facts:array<struct<field_code:string,status:string,expected_value:string,evidence_quote:string>>>>"
)

# keys of the persisted tables
TABLE_KEYS = {
    "policies": ["policy_id"],
    "documents": ["document_id"],
    "facts": ["fact_id"],
    "comparisons": ["comparison_id", "field_code"],
    "document_markdown": ["policy_id", "page_number"],
    "extra_findings": ["finding_id"],
    "chunks": ["document_id"],
}


TEXT_TABLES = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(read) if name in TEXT_TABLES else read


def spread(df: DataFrame) -> DataFrame:
    """Give costly row work one partition per core when the input has fewer.

    The check looks at the planned scan only. An input with at least as many
    splits as cores, as on a cluster, is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partition_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for costly work per row and for later operators on the same keys.

    The explicit number keeps the adaptive coalescing from packing few bytes but
    much computation into one task.
    """
    spark = df.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(partitions, *keys)


def document_intake(spark: SparkSession, path: str, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """O1: files under ``path`` with the reason for refusing them, if any.

    Suffix and size are metadata; only files that pass both are opened for their
    first bytes, and file contents never leave the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.lower("path").endswith(".pdf")
    small = F.col("length") <= max_bytes
    header = F.coalesce(F.substring("content", 1, len(DOCUMENT_HEADER)) == F.encode(F.lit(DOCUMENT_HEADER), "UTF-8"), F.lit(False))
    sized = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .filter(named & small)
        .select("path", header.alias("has_header"))
    )
    return _intake(files.select("path", "length").join(sized, "path", "left"))


def _intake(checked: DataFrame) -> DataFrame:
    accepted = F.coalesce("has_header", F.lit(False))
    return checked.select(
        "path",
        "length",
        accepted.alias("accepted"),
        F.when(~accepted, F.lit("FAILED")).otherwise(F.lit("RECEIVED")).alias("stage"),
        F.when(~accepted, F.lit("EXTRACT: arquivo inválido")).alias("message"),
    )


def intake_contents(files: DataFrame, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """O1 over a table ``(path, content binary)``: the same rules as for files.

    A row is narrow work: length and first bytes are read where the content
    lies, and the content is not part of the result. A null content is refused.
    """
    named = F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False))
    length = F.octet_length("content").cast("long")
    header = F.substring("content", 1, len(DOCUMENT_HEADER)) == F.encode(F.lit(DOCUMENT_HEADER), "UTF-8")
    sound = named & F.coalesce(length <= max_bytes, F.lit(False)) & F.coalesce(header, F.lit(False))
    return _intake(files.select("path", length.alias("length"), sound.alias("has_header")))


def scan_pages(pages: DataFrame, document_id: str) -> DataFrame:
    """O2: native text of a document in page order."""
    return pages.filter(F.col("document_id") == document_id).select("page_number", "native_text").orderBy("page_number")


def scan_markdown(pages: DataFrame, policy_id: str) -> DataFrame:
    """O122: stored markdown of a policy in page order."""
    return pages.filter(F.col("policy_id") == policy_id).orderBy("page_number")


CORRUPT = "__corrupt"


def read_json_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nested JSON documents of any number of files, and ``(file, error_code)`` of those that are broken.

    A document is a file, or a line without ``multi_line``. The raw text of a
    broken one is not passed on.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    read = spark.read.text(path, wholetext=multi_line).filter(~is_blank(F.col("value"))).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("document"))
    read = compute_once(read, document=F.col("document"))
    broken = F.col("document").isNull() | F.col(f"document.{CORRUPT}").isNotNull()
    return read.filter(~broken).select("document.*").drop(CORRUPT), read.filter(broken).select("file", F.lit("JSON_INVALID").alias("error_code"))


def write_json_documents(documents: DataFrame, path: str) -> None:
    """Nested rows as JSON, one document a line, in as many files as the partitions of ``documents``."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").text(path)


def load_bundles(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Policy bundles (one JSON document per file, or per line) as flat tables; broken ones are ``rejects``."""
    bundles, rejects = read_json_documents(spark, path, BUNDLE_SCHEMA, multi_line)
    return {
        "policies": bundles.select("policy.*"),
        "documents": bundles.select(F.inline("documents")),
        "evidence": bundles.select(F.inline("evidences")),
        "responses": bundles.select(
            "policy.policy_id", F.posexplode("llm_output").alias("position", "item")
        ).select("policy_id", "position", "item.*"),
        "rejects": rejects,
    }


def load_reference_set(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, expected facts, violations) of reference sets.

    FOUND needs an expected value, NOT_FOUND forbids one, a field occurs once
    per case. Violations name the rule and the key, never the content; a broken
    document is a violation that names its file.
    """
    sets, rejects = read_json_documents(spark, path, REFERENCE_SET_SCHEMA, multi_line)
    cases = sets.select("reference_version", F.inline("cases"))
    chunks = cases.select("case_id", "policy_id", F.inline("chunks"))
    expected = cases.select("case_id", "policy_id", F.inline("expected_facts"))
    broken = rejects.select(F.col("file").alias("case_id"), F.lit(None).cast("string").alias("field_code"), F.col("error_code").alias("violation"))
    return chunks, expected, expected_violations(expected).unionByName(broken)


def expected_violations(expected: DataFrame) -> DataFrame:
    value = F.coalesce(F.trim("expected_value"), F.lit("null"))
    has_value = ~value.isin("null", "", "{}")
    rule = (
        F.when(~F.coalesce(F.col("status").isin(*FACT_STATUSES), F.lit(False)), F.lit("STATUS_UNKNOWN"))
        .when((F.col("status") == "FOUND") & ~has_value, F.lit("FOUND_WITHOUT_VALUE"))
        .when((F.col("status") == "NOT_FOUND") & has_value, F.lit("NOT_FOUND_WITH_VALUE"))
    )
    single = expected.select("case_id", "field_code", rule.alias("violation")).filter(F.col("violation").isNotNull())
    repeated = (
        expected.groupBy("case_id", "field_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("case_id", "field_code", F.lit("FIELD_CODE_REPEATED").alias("violation"))
    )
    return single.unionByName(repeated)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """Evidence rows that break their contract."""
    rule = (
        F.when(~F.coalesce(F.col("page_number") >= 1, F.lit(False)), F.lit("PAGE_NUMBER"))
        .when(F.coalesce(F.length("quoted_text"), F.lit(0)) < 1, F.lit("QUOTED_TEXT"))
        .when(~F.coalesce(F.col("retrieval_score").between(0, 1), F.lit(True)), F.lit("RETRIEVAL_SCORE"))
        .when(~F.coalesce(F.col("ocr_confidence").between(0, 1), F.lit(True)), F.lit("OCR_CONFIDENCE"))
        .when(
            ~F.coalesce(F.col("source_type").isin("NATIVE_TEXT", "PADDLEOCR", "PP_STRUCTURE"), F.lit(False)),
            F.lit("SOURCE_TYPE"),
        )
    )
    return evidence.withColumn("violation", rule).filter(F.col("violation").isNotNull())


def latest_by_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last in ``order``, by partial aggregation."""
    payload = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), order).alias("__row")).select(*keys, "__row.*").select(
        *rows.columns
    )


def merge_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key, then insert, as one plan.

    ``keys`` may be coarser than a row (all chunks of a document): every old row
    of an incoming key goes, all incoming rows stay.
    """
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


BUCKET = "key_bucket"


def key_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(
    incoming: DataFrame, path: str, keys: list[str], buckets: int = 64, replaced: DataFrame | None = None,
    bucket_keys: list[str] | None = None,
) -> None:
    """Idempotent keyed write to a parquet table partitioned by a hash bucket of the key.

    Only the partitions of the keys at hand are read and replaced (dynamic
    partition overwrite), which the commit protocol swaps in at the end of the
    job; a failed or repeated run leaves the same table. The merged rows are
    checkpointed before the overwrite because they are read from the same path.
    ``replaced`` names keys whose old rows go even when nothing new comes;
    ``bucket_keys`` are the keys that choose the partition (all by default). The
    rebalance hint splits a bucket that one hot key fills.
    """
    spark = incoming.sparkSession
    bucket = key_bucket(bucket_keys or keys, buckets)
    new_rows = incoming.withColumn(BUCKET, bucket)
    if _exists(spark, path):
        ensure_checkpoint_dir(spark)
        gone = (incoming if replaced is None else replaced).select(*keys).distinct().withColumn(BUCKET, bucket)
        existing = spark.read.parquet(path).join(gone.select(BUCKET).distinct(), BUCKET, "left_semi")
        kept = existing.join(gone, [*keys, BUCKET], "left_anti")
        new_rows = kept.unionByName(new_rows.select(*existing.columns)).checkpoint()
        emptied = gone.select(BUCKET).distinct().join(new_rows.select(BUCKET).distinct(), BUCKET, "left_anti")
        # A partition that loses its last row is not written, so its marker row keeps the swap complete.
        new_rows = new_rows.unionByName(emptied, allowMissingColumns=True)
    (
        new_rows.hint("rebalance", BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of a keyed table, without the marker rows of emptied partitions."""
    return spark.read.parquet(path).dropna("all", subset=keys).drop(BUCKET)


def read_keyed(spark: SparkSession, path: str, wanted: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of the wanted values of ``key`` from a table bucketed by it: only their partitions are read."""
    places = wanted.select(key).distinct().withColumn(BUCKET, key_bucket([key], buckets))
    return spark.read.parquet(path).join(places, [BUCKET, key], "left_semi").drop(BUCKET)
