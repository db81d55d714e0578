"""Reading documents and records, writing results. Every reader is Spark's own, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "document string, sha256 string, pages int, extracted_at string, duplicate_of string, records array<struct<page:int,kind:string,strategy:string,reason:string,"
    "text:string,engine:string,seconds:double,characters:int,tables:int,warnings:array<string>,error:string,deferred:boolean,extractor_version:int>>, _corrupt_record string"
)


def spread(df: DataFrame, least_gain: int = 2) -> DataFrame:
    """df over all cores if its files make at most a ``least_gain``-th as many splits (a small file of one row group is
    one task however many cores wait). Large inputs have more splits than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * least_gain <= cores else df


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, length, content of every PDF below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length", "content")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """name (from the header comment, else the file's), markdown of every parsed document."""
    read = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    own = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.md$", "")
    return read.select(source_name(F.col("value"), own).alias("name"), F.col("value").alias("markdown"))


def source_name(markdown, fallback):
    """The name that ``<!-- source: name -->`` states, else the fallback."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(markdown, r"<!--\s*source:\s*(.*?)\s*-->", 1)), F.lit("")), fallback)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Page records of all readable sidecars, one row per page; unreadable files are left out."""
    read = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    good = read.where("_corrupt_record IS NULL AND records IS NOT NULL")
    return good.select("document", "sha256", F.explode("records").alias("r")).select("document", "sha256", "r.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines and a summary per document."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")).write.mode("overwrite").json(f"{path}/summary")


def markdown_of(records: DataFrame) -> DataFrame:
    """document, markdown: pages in order behind their markers; pages without text leave a visible note, skipped pages nothing."""
    note = (
        F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("> extraction failed: "), "error"))
        .when(F.col("deferred"), F.lit("> waits for OCR"))
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("> no text"))
        .otherwise(F.col("text"))
    )
    head = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" | "), "kind", F.lit(" | "), F.coalesce("engine", F.lit("")), F.lit(" -->\n\n"))
    pages = records.where("strategy <> 'skip'").groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", F.concat(head, note).alias("t")))).alias("p"))
    return pages.select("document", F.concat(F.lit("<!-- source: "), "document", F.lit(" -->\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("markdown"))


def write_sidecars(records: DataFrame, path: str) -> None:
    """Page records below ``path``, one folder per document, added page by page: what is written stays when a later page fails,
    and a page that is written again stands beside its old record until ``latest_sidecars`` picks the newer."""
    records.write.mode("append").partitionBy("document").json(path)


def latest_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest record of each document and page (by extracted_at) of what ``write_sidecars`` wrote."""
    rows = spark.read.schema(schema).json(path)
    newest = rows.groupBy("document", "page").agg(F.max_by(F.struct("*"), "extracted_at").alias("r"))
    return newest.select("r.*")


def remove_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Removes files of exactly these names that stand in the folder itself, in any store that Spark knows; what was removed.

    A name with a separator or of a folder above is refused, so nothing outside the folder can go."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for name in names:
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise ValueError(f"not the name of a file: {name!r}")
        file = jvm.org.apache.hadoop.fs.Path(base, name)
        if fs.exists(file) and fs.getFileStatus(file).isFile() and fs.delete(file, False):
            gone.append(name)
    return gone


def derived_names(doc_id: str) -> list[str]:
    """The files that extraction makes of a document, by its id and never by its name."""
    return [f"{doc_id}.md", f"{doc_id}.pages.json", f"{doc_id}.pdf"]
