"""Views over the driver's tables that stand in for annotated documents.

Each view has one text for both engines, with a few words that differ between
them filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "nation", "region", "supplier", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark", "part", "embeddings")
SPARK = {"series": "explode(sequence(0, {n}))"}
DUCK = {"series": "unnest(generate_series(0, {n}))"}

TAG = "CASE no WHEN 0 THEN 'NAME' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'AGE' WHEN 3 THEN 'IDENTIFICATION_NUMBER' WHEN 4 THEN 'AFFILIATION' WHEN 5 THEN 'SEX' WHEN 6 THEN 'RELATIONSHIP' ELSE 'EMAIL_ADDRESS' END"
#: Values of annotator a by tag number.
VALUE = """CASE no WHEN 0 THEN c_name WHEN 1 THEN concat(c_mktsegment, ' / ', n_name, ' / ', r_name)
  WHEN 2 THEN CASE s % 4 WHEN 2 THEN concat(CAST(20 + s % 30 AS STRING), '-', CAST(29 + s % 30 AS STRING)) ELSE CAST(20 + s % 50 AS STRING) END
  WHEN 3 THEN concat('ID-', lpad(CAST(s AS STRING), 6, '0')) WHEN 4 THEN concat(c_mktsegment, ' Holdings')
  WHEN 5 THEN CASE s % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'F' WHEN 2 THEN 'woman' ELSE 'm' END
  WHEN 6 THEN CASE s % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'dating' WHEN 2 THEN 'married' WHEN 3 THEN 'separated' ELSE 'widow' END
  ELSE concat('User', CAST(s AS STRING), '@x.com') END"""
OTHER = """CASE no WHEN 0 THEN concat('Customer ', lpad(CAST(s + 17 AS STRING), 9, '0')) WHEN 1 THEN concat('Elsewhere / ', n_name, ' / ', r_name) WHEN 2 THEN CAST(24 + s % 50 AS STRING)
  WHEN 3 THEN lpad(CAST(s AS STRING), 6, '0') WHEN 4 THEN concat(c_mktsegment, ' Holding') WHEN 5 THEN 'man' WHEN 6 THEN 'unmarried' ELSE concat(' user', CAST(s AS STRING), '@X.com ') END"""
VAGUE = """CASE no WHEN 0 THEN c_mktsegment WHEN 1 THEN concat(n_name, ' / ', r_name) WHEN 2 THEN CASE s % 9 WHEN 0 THEN '30s' ELSE '25-35' END
  WHEN 3 THEN concat('1', lpad(CAST(s AS STRING), 6, '0')) WHEN 4 THEN 'Other' WHEN 5 THEN 'female' WHEN 6 THEN 'wed' ELSE 'x@y.z' END"""
BASE = """SELECT c_custkey AS s, c_nationkey AS d, c_name, n_name, r_name, c_mktsegment FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
#: The lines of an order, numbered from 0; line numbers repeat in the data.
LINES = "SELECT l_orderkey, l_suppkey, l_discount, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS li FROM {lineitem}"

VIEWS = {
    "ann_a": f"""SELECT CAST(d AS BIGINT) AS data_id, s AS subject_id, {TAG} AS tag, 0 AS pos, {VALUE} AS keyword, CAST(1 + (s * 3 + no * no) % 5 AS INT) AS certainty, CAST(1 + (s + no) % 3 AS INT) AS hardness
      FROM (SELECT *, {{series7}} AS no FROM ({BASE}) AS base) AS t""",
    "ann_b": f"""SELECT data_id, subject_id, tag, pos, keyword, certainty, hardness FROM (
      SELECT CAST(d AS BIGINT) AS data_id, s AS subject_id, {TAG} AS tag, pos,
        CASE (s * 7 + no * 3 + pos * 5) % 8 WHEN 1 THEN '' WHEN 2 THEN upper({VALUE}) WHEN 3 THEN {OTHER} WHEN 4 THEN {VAGUE} WHEN 5 THEN lower({VALUE}) WHEN 6 THEN concat({VALUE}, ' ') ELSE {VALUE} END AS keyword,
        CAST((s + no * 2 + pos) % 6 AS INT) AS certainty, CAST(1 + (s + no + pos) % 3 AS INT) AS hardness, CASE WHEN pos = 0 AND (s + no) % 11 = 5 THEN 0 WHEN pos = 1 AND (s + no) % 3 <> 0 THEN 0 ELSE 1 END AS there
      FROM (SELECT *, {{series1}} AS pos FROM (SELECT *, {{series7}} AS no FROM ({BASE}) AS base) AS t) AS u) AS v WHERE there = 1""",
    "subj_a": f"SELECT l_orderkey AS data_id, CAST(li AS INT) AS idx, CAST(li AS STRING) AS id, concat('line of supplier ', CAST(l_suppkey AS STRING)) AS description FROM ({LINES}) AS t",
    "subj_b": f"SELECT l_orderkey AS data_id, CAST(bi AS INT) AS idx, CAST(bi AS STRING) AS id, concat('sold by ', CAST(l_suppkey AS STRING)) AS description, CAST(li AS INT) AS a_idx, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY li) - 1 AS bi FROM ({LINES}) AS t WHERE l_discount >= 0.02) AS u",
}


def fill(text: str, words: dict[str, str], tables: dict[str, str]) -> str:
    return text.format(series7=words["series"].format(n=7), series1=words["series"].format(n=1), **tables)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(fill(text, SPARK, {t: "{" + t + "}" for t in used}), **used)


def duck_view(name: str) -> str:
    return fill(VIEWS[name], DUCK, {t: t for t in TABLES})


#: Personal data in documents: e-mail, IPv4, card and phone numbers, and licence lines that need no masking.
EMAIL, IPV4, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]{16}", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
LICENSE, TOKEN = r"(?:Apache|MIT|Public) License", r"token = .[0-9a-f]{40}"
GOLD = "|".join((EMAIL, IPV4, CARD, PHONE, LICENSE))
REPORTED = "|".join((EMAIL, CARD, TOKEN))
HIDDEN = "|".join((EMAIL, CARD))


def duck_spans(pattern: str) -> str:
    """CTE text: data_id, pos, span_text, start_offset, end_offset of a pattern in documents."""
    return f"""(SELECT data_id, CAST(i - 1 AS INT) AS pos, hits[i] AS span_text, CAST(s AS INT) AS start_offset, CAST(s + length(hits[i]) AS INT) AS end_offset FROM (
      SELECT data_id, i, hits, coalesce(list_sum([length(g) for g in gaps[1:i]]), 0) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) AS s
      FROM (SELECT data_id, gaps, hits, unnest(generate_series(1, len(hits))) AS i FROM (
        SELECT doc_id AS data_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM documents WHERE regexp_matches(text, '{pattern}')))))"""


MENTION_COLUMNS = """data_id, pos, span_text, start_offset, end_offset, lower(span_text) AS entity_id,
  CASE WHEN span_text LIKE '%License' THEN 'MISC' ELSE 'CODE' END AS entity_type,
  CASE WHEN span_text LIKE '%License' THEN 'NO_MASK' WHEN span_text LIKE '%@%' OR span_text LIKE '(%' OR length(span_text) = 16 AND span_text NOT LIKE '%.%' THEN 'DIRECT' ELSE 'QUASI' END AS identifier_type"""


def spark_spans(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilframe.functions.text import pieces

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(pattern))
    return docs.select(F.col("doc_id").alias("data_id"), F.posexplode(pieces(F.col("text"), pattern)).alias("pos", "s")).select("data_id", "pos", "s.*")


def spark_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = MENTION_COLUMNS.split(",\n")
    first, rest = cols[0], cols[1:]
    return spark_spans(spark, sf_dir, GOLD).selectExpr(*[c.strip() for c in first.split(", ")], *[c.strip() for c in rest])


def duck_mentions() -> str:
    return f"(SELECT {MENTION_COLUMNS} FROM {duck_spans(GOLD)})"


def spark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, text, anonymized_text: e-mails and card numbers hidden."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("data_id"), "text", F.regexp_replace("text", HIDDEN, "[CODE]").alias("anonymized_text"))


DUCK_DOCUMENTS = f"(SELECT doc_id AS data_id, text, regexp_replace(text, '{HIDDEN}', '[CODE]', 'g') AS anonymized_text FROM documents)"
