"""Readers and writers of document collections: JSONL, JSON reports, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.sources.json_array import read_json_array


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.ANNOTATED, strict: bool = True) -> DataFrame:
    """One document a line; blank lines are skipped, bad ones raise (or are kept in ``_corrupt_record``)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_jsonl_only(spark: SparkSession, path: str, schema: str = schemas.ANNOTATED) -> DataFrame:
    """The same for paths that end in .jsonl; other paths are refused."""
    if not path.endswith(".jsonl"):
        raise ValueError(f"not a .jsonl path: {path}")
    return read_jsonl(spark, path, schema)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds file and ordinal: the order of lines within a file split, of splits within a file by their start."""
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("ordinal", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))


def flexible_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose PIIs are an array or an object keyed by tag, as one long table.

    The strict schema reads the array form; lines that it rejects are read again
    as variants.  Returns data_id, subject_id, description, tag, pos, keyword,
    certainty, hardness.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    v = F.try_parse_json("value")
    docs = lines.select(F.try_variant_get(v, "$.metadata.data_id", "string").alias("data_id"), F.posexplode(F.try_variant_get(v, "$.subjects", "array<variant>")).alias("idx", "s"))
    people = docs.select(
        "data_id", F.coalesce(F.try_variant_get("s", "$.id", "string"), F.col("idx").cast("string")).alias("subject_id"), F.try_variant_get("s", "$.description", "string").alias("description"),
        F.try_variant_get("s", "$.PIIs", "array<variant>").alias("many"), F.try_variant_get("s", "$.PIIs", "map<string,variant>").alias("keyed"),
    )

    def values(df: DataFrame, tag) -> DataFrame:
        return df.select(
            "data_id", "subject_id", "description", tag.alias("tag"), "pos",
            F.coalesce(F.try_variant_get("p", "$.keyword", "string"), F.try_variant_get("p", "$.value", "string")).alias("keyword"),
            F.coalesce(F.try_variant_get("p", "$.certainty", "int"), F.lit(0)).alias("certainty"), F.coalesce(F.try_variant_get("p", "$.hardness", "int"), F.lit(1)).alias("hardness"),
        )

    tags = F.array(*map(F.lit, schemas.TAGS))
    listed = people.where("many is not null").select("data_id", "subject_id", "description", F.posexplode("many").alias("pos", "p"))
    keyed = people.where("many is null and keyed is not null").select("data_id", "subject_id", "description", F.posexplode("keyed").alias("pos", "k", "p"))
    return values(listed, F.coalesce(F.try_variant_get("p", "$.tag", "string"), F.get(tags, F.col("pos")))).unionByName(values(keyed, F.col("k")))


def long_annotations(docs: DataFrame, subjects: str = "subjects") -> DataFrame:
    """data_id, subject_id (position), id, description, tag, pos, keyword, certainty, hardness of annotated documents."""
    people = docs.select(F.col("metadata.data_id").alias("data_id"), F.posexplode(subjects).alias("subject_id", "s"))
    return people.select("data_id", "subject_id", F.coalesce("s.id", F.col("subject_id").cast("string")).alias("id"), "s.description", F.posexplode("s.PIIs").alias("pos", "p")).select("data_id", "subject_id", "id", "description", "p.tag", "pos", "p.keyword", "p.certainty", "p.hardness")


def long_mentions(docs: DataFrame) -> DataFrame:
    """Entity mentions of documents: data_id, pos and the entity's fields."""
    return docs.select(F.col("metadata.data_id").alias("data_id"), F.posexplode("entities").alias("pos", "e")).select("data_id", "pos", "e.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One document a line, non-ASCII text as it is."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports (one JSON object a file) of a path or glob, with their ``file``."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def read_report_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_evaluation.json`` of a folder; Spark raises if there is none."""
    return read_reports(spark, f"{folder.rstrip('/')}/*_evaluation.json")


def read_annotators(spark: SparkSession, folder: str, schema: str = schemas.ANNOTATED) -> DataFrame:
    """Every JSONL file of a folder; ``annotator`` is its name without the extension."""
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/*.jsonl").withColumn("annotator", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses by data_id; lines that can't be read are left out."""
    rows = read_jsonl(spark, path, schemas.RESPONSE_LOG, strict=False)
    return rows.where("_corrupt_record is null and data_id is not null").drop("_corrupt_record").dropDuplicates(["data_id"])


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training documents (a JSON array a file, split into ranges), a row per annotator and mention."""
    docs = read_json_array(spark, path, schemas.TRAINING_DOC)
    return docs.select("doc_id", "dataset_type", "text", F.explode("annotations").alias("annotator", "a")).select("doc_id", "dataset_type", "text", "annotator", F.posexplode("a.entity_mentions").alias("pos", "m")).select("doc_id", "dataset_type", "text", "annotator", "pos", "m.*")


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as JSON text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_responses(df: DataFrame, path: str) -> None:
    """Raw model responses, a folder for each stage."""
    df.write.mode("append").partitionBy("stage").json(path)


def errors(df: DataFrame, error_type: str, message: str = "error") -> DataFrame:
    """Rows of the error log from rows with data_id and a message."""
    return df.select("data_id", F.lit(error_type).alias("error_type"), F.col(message).alias("error"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def write_case_log(logs: DataFrame, path: str) -> None:
    """Case lines in order of their group."""
    logs.orderBy("case_group", "log").select("log").write.mode("overwrite").text(path)


def text_column(df: DataFrame, path: str):
    """The text to analyse: the anonymized one for paths of anonymized collections, else the text; per row the one that is there."""
    if "/anonymized/" in path and "anonymized_text" in df.columns:
        return F.coalesce("anonymized_text", "text")
    return F.col("text")


def short_ids(spark: SparkSession, n: int) -> DataFrame:
    """n distinct random ids of five characters (hexadecimal, so at most 16**5 of them)."""
    if n > 16**5:
        raise ValueError("five characters can't name so many")
    return spark.range(4 * n + 64).select(F.substring(F.expr("uuid()"), 1, 5).alias("id")).distinct().limit(n)


def same_dataset(first: str, second: str) -> str:
    """The dataset that both paths name; different or no names raise."""
    kinds = [next((k for k in ("panorama", "tab") if k in p.lower()), None) for p in (first, second)]
    if kinds[0] is None or kinds[0] != kinds[1]:
        raise ValueError(f"paths of different or unknown datasets: {first}, {second}")
    return kinds[0]


def first_documents(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` documents in order of the lines."""
    return df.orderBy(ordinal).limit(n)


def is_anonymized(df: DataFrame) -> bool:
    """Whether the collection has anonymized texts: the column, and at least one value."""
    return "anonymized_text" in df.columns and not df.where("anonymized_text is not null").limit(1).isEmpty()


def split_by_part(df: DataFrame, agreed: str, conflict: str) -> None:
    """The two outputs of a consensus, from one computation."""
    kept = df.persist()
    for part, path in (("agreed", agreed), ("conflict", conflict)):
        write_jsonl(kept.where(F.col("part") == part), path)
    kept.unpersist()


def result_path(source: str, root: str, method: str, stamp: str) -> str:
    """Where the results for a source go: a folder of its dataset below ``root``, or beside the source if its path names none."""
    folder, _, name = source.rpartition("/")
    kind = next((k for k in ("panorama", "tab") if k in source.lower()), None)
    base = name.rsplit(".", 1)[0] if "." in name[1:] else name
    place = folder if kind is None else f"{root.rstrip('/')}/{kind}"
    return f"{place + '/' if place or kind is None and source.startswith('/') else ''}{base}_{method}_{stamp}.jsonl"
