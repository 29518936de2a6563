"""Files: JSON and JSONL documents, parser artifacts, provenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT_ITEM = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("list_body", T.StringType()), T.StructField("text_level", T.IntegerType()), T.StructField("page_idx", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("table_body", T.StringType()), T.StructField("table_caption", T.ArrayType(T.StringType())), T.StructField("img_path", T.StringType())]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """The objects of a JSONL file; blank lines are skipped. A line that is no object is an error, or skipped if not ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def document_name(path: Column) -> Column:
    """The document of an artifact's path: its file name without the suffix, or the folder if nothing is left."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"_content_list(?:_v2)?\.json$|\.[A-Za-z0-9]+$", "")
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.element_at(F.split(path, "/"), -2))


def read_content_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """(document_id, block_index, content item fields) of the parser outputs that match ``pattern``; newer variants (_v2) are left out."""
    whole = spark.read.format("binaryFile").load(pattern).where(~F.col("path").rlike(r"_v2\.json$"))
    items = F.from_json(F.col("content").cast("string"), T.ArrayType(CONTENT_ITEM))
    return whole.select(document_name(F.col("path")).alias("document_id"), F.posexplode(items).alias("block_index", "item")).select("document_id", "block_index", "item.*")


def block_text(kind: Column, text: Column, list_body: Column) -> Column:
    """The text of a content item: lists fall back to their body."""
    return F.when(kind == "list", F.coalesce(F.nullif(text, F.lit("")), list_body)).otherwise(text)


def provenance(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of the files that match."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def artifact_kind(path: Column) -> Column:
    """The kind of a parser artifact by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.endswith("_content_list.json"), "content_list").when(name.endswith(".json"), "json").when(name.endswith(".md"), "markdown").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(name.endswith(".jsonl"), "jsonl").otherwise("other")


def profile(spark: SparkSession, pattern: str) -> DataFrame:
    """(kind, n_files, n_bytes) of the files that match."""
    listed = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return listed.groupBy(artifact_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def is_zip(content: Column) -> Column:
    """Whether bytes begin as a zip file does."""
    return F.hex(F.substring(content, 1, 4)) == "504B0304"


def artifact_folder(spark: SparkSession, pattern: str) -> str:
    """The one folder with a content list among the files that match (newer variants, _v2, aside); an error for none or several."""
    paths = spark.read.format("binaryFile").load(pattern).where(F.col("path").endswith("_content_list.json"))
    folders = [r[0] for r in paths.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().limit(2).collect()]
    if len(folders) != 1:
        raise ValueError("several folders hold a content list" if folders else "no folder holds a content list")
    return folders[0]


def located(files: DataFrame, name: str) -> DataFrame:
    """The row of ``files`` (path) for a document's file: by its exact name, else by its trimmed stem, the shortest name first.

    Names with a path in them are refused, a missing suffix is added.
    """
    wanted = name.strip()
    if not wanted or "/" in wanted or "\\" in wanted:
        return files.limit(0)
    wanted = wanted if wanted.lower().endswith(".pdf") else wanted + ".pdf"
    base = F.element_at(F.split("path", "/"), -1)
    stem = lambda c: F.trim(F.regexp_replace(c, r"(?i)\.pdf$", ""))
    found = files.withColumn("_name", base).where((F.trim("_name") == wanted) | (stem(F.col("_name")) == wanted[:-4].strip()))
    return found.orderBy((F.col("_name") != wanted).cast("int"), F.length("_name"), "_name").limit(1).drop("_name")


def with_siblings(files: DataFrame, *suffixes: str) -> DataFrame:
    """The content lists among ``files`` (path), each with the paths of its siblings of the same document and folder by suffix, null where there is none."""
    stem = lambda c, suffix: F.regexp_replace(c, re.escape(suffix) + "$", "")
    out = files.where(F.col("path").endswith("_content_list.json")).withColumn("_stem", stem(F.col("path"), "_content_list.json"))
    for suffix in suffixes:
        other = files.where(F.col("path").endswith(suffix)).select(stem(F.col("path"), suffix).alias("_stem"), F.col("path").alias(suffix.strip("_.").split(".")[0]))
        out = out.join(other, "_stem", "left")
    return out.drop("_stem")


def latest_artifacts(files: DataFrame) -> DataFrame:
    """Of each document's content lists (path, modified) the latest; of equal ones in one artifact the folder ``hybrid_auto`` before ``auto``."""
    lists = files.where(F.col("path").endswith("_content_list.json"))
    folder = F.element_at(F.split("path", "/"), -2)
    best = F.struct("modified", (folder == "hybrid_auto").cast("int").alias("hybrid"), "path")
    return lists.groupBy(document_name(F.col("path")).alias("document_id")).agg(F.max(best).alias("b")).select("document_id", "b.path", "b.modified")


def pending(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The ``documents`` (document_id) without an artifact: what a run still has to do."""
    return documents.join(artifacts.select("document_id"), "document_id", "left_anti")


def tolerant_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSONL file of sources: bad lines and those whose id or text is no string are skipped, of a repeated id the last counts; a missing file is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "id string, text string")
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().alias("at"))
    of = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    kept = lines.where((F.schema_of_variant(of("id")) == "STRING") & (F.schema_of_variant(of("text")) == "STRING"))
    return kept.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.text", "string").alias("text"), "at").groupBy("id").agg(F.max_by("text", "at").alias("text"))
