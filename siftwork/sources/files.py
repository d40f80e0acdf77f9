"""Sources and sinks over any path that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import labels, scan

SUPPORTED = ("md", "txt", "html", "htm", "csv", "pdf", "docx")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, size, supported) of all files below root, without hidden ones; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(~F.rlike("path", F.lit(r"/\.[^/]+$"))).select("path", suffix.alias("suffix"), "size", suffix.isin(*SUPPORTED).alias("supported"))


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """Text and Markdown files as one page each."""
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(T.slug(F.regexp_extract("path", r"([^/]*)$", 1)).alias("doc_id"), T.title(F.col("path")).alias("title"), F.lit(1).alias("page_no"), "text", F.length("text").alias("char_count"))


def read_csv_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Each row of a CSV file as 'Row i -- column: value; ...', blanks left out; the separator is the commonest in the header."""
    if separator is None:
        head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
        separator = max(",;\t|", key=head.count)
    rows = spark.read.option("header", True).option("sep", separator).csv(path)
    filled = [F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`")))) for c in rows.columns]
    # Row numbers follow the splits of the file, in order, and the rows in each.
    rows = rows.select(F.concat_ws("; ", *filled).alias("_t"), F.monotonically_increasing_id().alias("_m"))
    numbered = scan.numbered(rows, [], ["_m"], F.col("_m"), "row_no")
    return numbered.select("row_no", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(" -- "), "_t").alias("text"))


def guard(files: DataFrame, most_mb: int = 200, least_chars: int = 50) -> DataFrame:
    """load_error of documents (path, suffix, size, pages): too large, unsupported, or all pages scanned."""
    scanned = F.size(F.filter("pages", lambda p: F.length(p) < least_chars))
    error = F.when(F.col("size") > most_mb << 20, "too_large").when(~F.col("suffix").isin(*SUPPORTED), "unsupported").when((F.size("pages") > 0) & (scanned == F.size("pages")), "scanned")
    return files.withColumn("scanned_pages", scanned).withColumn("load_error", error)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines, with the defaults of a direct, answerable one."""
    schema = "qid string, question string, category string, answerable boolean, gold_docs array<string>, primary_spans array<string>, supporting_spans array<string>"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("category", F.coalesce("category", F.lit("direct"))).withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    return labels.parse_mot(spark.read.text(path).withColumnRenamed("value", "line"))


def read_yolo(spark: SparkSession, root: str, classes: int) -> DataFrame:
    rows = spark.read.text(root).select(F.regexp_extract("_metadata.file_path", r"([^/]*)\.txt$", 1).alias("image_id"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    return labels.parse_labels(rows, classes)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with exactly the columns of `schema`, in any order; a missing one is an error."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in wanted.names if c not in have]:
        raise ValueError(f"manifest lacks columns: {missing}")
    return spark.read.option("header", True).csv(path).select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])


def write_store(df: DataFrame, path: str, fingerprint: str, by: str | None = None) -> None:
    """A Parquet table that carries the fingerprint of the settings that made it."""
    out = df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def read_store(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """The table, if it was made with the same settings."""
    rows = spark.read.parquet(path)
    other = rows.where(F.col("fingerprint") != fingerprint).limit(1).collect()
    if other:
        raise ValueError(f"stale store: made with {other[0]['fingerprint']}, wanted {fingerprint}")
    return rows.drop("fingerprint")
