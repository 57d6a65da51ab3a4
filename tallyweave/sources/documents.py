"""Files as tables. JSON documents are one object to a file; land them as Parquet once, since text is not pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """(path, stem, suffix, length) of the files under the roots; contents are not read, roots that don't exist are passed over."""
    fs = spark._jvm.org.apache.hadoop.fs
    there = [r for r in roots if (p := fs.Path(r)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    empty = spark.createDataFrame([], "path string, stem string, suffix string, length long")
    if not there:
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = files.select("path", F.expr("left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - length(regexp_extract(element_at(split(path, '/'), -1), '([.][^.]*)$', 1)))").alias("stem"), suffix.alias("suffix"), "length")
    return out.filter(F.col("suffix").isin([s.lower() for s in suffixes])).dropDuplicates(["path"])


def documents(spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(documents with their path, paths that hold no such object). A corrupt file is a reject, not a failure; a byte order mark is passed over."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    rows = raw.select("path", F.from_json(F.regexp_replace("value", "^\ufeff", ""), whole, {"mode": "PERMISSIVE"}).alias("d"))
    fine = F.col("d").isNotNull() & F.col("d._corrupt_record").isNull()
    return rows.filter(fine).select(*[F.col(f"d.{f.name}").alias(f.name) for f in schema.fields], "path"), rows.filter(~fine).select("path")


def manifest_cases(manifests: DataFrame) -> DataFrame:
    """One row for each sample (struct with sample_id) of manifests (samples), blank ids left out, in order of id, with its manifest."""
    each = manifests.select("path", F.explode("samples").alias("s")).select(F.col("path").alias("manifest"), "s.*")
    return each.filter(F.btrim(F.coalesce("sample_id", F.lit(""))) != "").orderBy("sample_id")


def winning_manifests(manifests: DataFrame, root: str) -> DataFrame:
    """Of samples (manifest, sample_id, ...) that several manifests hold, those of the root's own manifest, else of the first in order of path."""
    place = F.row_number().over(W.partitionBy("sample_id").orderBy(F.col("manifest") != root, "manifest"))
    return manifests.withColumn("_n", place).filter("_n = 1").drop("_n")


def append_history(entries: DataFrame, path: str, seq: str = "seq") -> DataFrame:
    """The history at ``path`` with the entries appended, each numbered after those before it, in the order of the entries' own ``at``."""
    spark = entries.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    last = (spark.read.parquet(path).agg(F.max(seq)).first()[0] or 0) if there else 0
    numbered = entries.withColumn(seq, (F.row_number().over(W.orderBy("at")) + last).cast("long"))  # a history has as many entries as a person makes
    numbered.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def exports(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines 'export K=V' or 'K=V'; comments and other lines are passed over, quotes about a value go."""
    line = F.regexp_replace(F.btrim("value"), r"^export\s+", "")
    rows = spark.read.text(path).select(line.alias("l")).filter(F.col("l").rlike(r"^[A-Za-z_][A-Za-z0-9_]*="))
    value = F.regexp_replace(F.btrim(F.regexp_extract("l", r"^[^=]*=(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    return rows.select(F.regexp_extract("l", "^([^=]*)=", 1).alias("key"), value.alias("value"))


def ocr_items(payloads: DataFrame, key: list[str]) -> DataFrame:
    """One row for each box of a payload (boxes, texts, scores): short arrays give an empty text and score 0, texts beyond the boxes are dropped."""
    each = payloads.select(*key, F.posexplode("boxes").alias("idx", "poly"), "texts", "scores")
    return each.select(*key, "idx", "poly", F.coalesce(F.get("texts", "idx"), F.lit("")).alias("text"), F.coalesce(F.get("scores", "idx"), F.lit(0.0)).alias("score"))


def write_results(results: DataFrame, path: str, partition: str) -> None:
    """One JSON object to a line, a folder for each value of ``partition``."""
    results.write.mode("append").partitionBy(partition).json(path)


def write_manifest(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of fixed columns with a header."""
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)
