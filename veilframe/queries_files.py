"""Registered queries of files and streams: each writes into the shared folder and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilframe import backends, schemas
from veilframe.functions import parse, repair
from veilframe.operators import alignment, spans, stats
from veilframe.plans import evaluate, infer, utility
from veilframe.queries import register, table
from veilframe.sources import jsonl
from veilframe.sources.folders import as_one_file, work_folder
from veilframe.sources.json_array import read_json_array
from veilframe.streaming import incremental


def annotated(spark, sf_dir):
    """Documents in the annotated shape, one person each with two values; every third has an anonymized text."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    pii = lambda tag, v, c: F.struct(F.lit(tag).alias("tag"), v.alias("keyword"), F.lit(c).alias("certainty"), F.lit(1).alias("hardness"))
    person = F.struct(F.lit("0").alias("id"), F.coalesce("source", F.lit("")).alias("description"), F.array(pii("NAME", F.concat(F.lit("n"), "doc_id"), 5), pii("AGE", F.coalesce("lang", F.lit("")), 3)).alias("PIIs"))
    return d.select(
        F.struct(F.col("doc_id").cast("string").alias("data_id"), F.lit(1).alias("number_of_subjects")).alias("metadata"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).alias("anonymized_text"), F.array(person).alias("subjects"),
    )


DOCS = "SELECT CAST(doc_id AS VARCHAR) AS data_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN upper(lang) END AS anonymized_text, doc_id, lang, source FROM documents WHERE doc_id IS NOT NULL"


@register("jsonl_round_trip", f"SELECT data_id, sha256(text) AS sha, anonymized_text FROM ({DOCS})")
def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines and read with the strict schema."""
    path = f"{work_folder(spark)}/docs.jsonl"
    jsonl.write_jsonl(annotated(spark, sf_dir), path)
    return jsonl.read_jsonl_only(spark, path).select("metadata.data_id", F.sha2("text", 256).alias("sha"), "anonymized_text")


@register("jsonl_append", f"SELECT data_id, tag, keyword, certainty FROM (SELECT data_id, 'NAME' AS tag, 'n' || doc_id AS keyword, 5 AS certainty FROM ({DOCS}) UNION ALL SELECT data_id, 'AGE', coalesce(lang, ''), 3 FROM ({DOCS}))")
def jsonl_append(spark, sf_dir):
    """Two halves appended to one collection, as the long table of values."""
    path, docs = f"{work_folder(spark)}/docs.jsonl", annotated(spark, sf_dir)
    even = F.col("metadata.data_id").cast("long") % 2 == 0
    jsonl.write_jsonl(docs.where(even), path)
    jsonl.write_jsonl(docs.where(~even), path, append=True)
    return jsonl.long_annotations(jsonl.read_jsonl(spark, path)).select("data_id", "tag", "keyword", "certainty")


@register("jsonl_bad_lines", "SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS bad FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0")
def jsonl_bad_lines(spark, sf_dir):
    """Lines that can't be read are kept aside, blank ones skipped."""
    path = f"{work_folder(spark)}/docs.jsonl"
    line = F.when(F.col("c_custkey") % 7 == 0, F.lit("{broken")).when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('{"data_id": "'), "c_custkey", F.lit('"}')))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    rows = jsonl.read_jsonl(spark, path, "data_id string", strict=False)
    rows.write.parquet(f"{path}.read")
    return spark.read.parquet(f"{path}.read").agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt_record").alias("bad"))


@register("keep_last_line", f"SELECT data_id, sha256(text) AS sha FROM ({DOCS})")
def keep_last_line(spark, sf_dir):
    """Each document twice in one file, first with another text: the later line counts."""
    path = f"{work_folder(spark)}/docs.jsonl"
    docs = annotated(spark, sf_dir).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("text", F.when(F.col("part") == 0, F.lit("old")).otherwise(F.col("text")))
    docs.coalesce(1).sortWithinPartitions("part").drop("part").write.json(path)
    rows = jsonl.with_ordinal(jsonl.read_jsonl(spark, path)).withColumn("data_id", F.col("metadata.data_id"))
    return alignment.keep_last(rows, "data_id", "ordinal").select("data_id", F.sha2("text", 256).alias("sha"))


@register("report_folder", "SELECT 'eval_' || n_nationkey || '_evaluation.json' AS file, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def report_folder(spark, sf_dir):
    """One report a nation, read back from the folder."""
    folder = work_folder(spark)
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect():  # 25 rows
        one = spark.range(1).select(F.create_map(F.lit("name"), F.lit(r["n_name"]), F.lit("region"), F.lit(str(r["n_regionkey"]))).alias("config"), F.array().cast("array<int>").alias("detailed_results"))
        jsonl.write_report(one, f"{folder}/tmp")
        as_one_file(spark, f"{folder}/tmp", f"{folder}/eval_{r['n_nationkey']}_evaluation.json")
    return jsonl.read_report_folder(spark, folder).select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("config")["name"].alias("name"), F.col("config")["region"].alias("region"))


@register("annotator_files", f"SELECT coalesce(lang, 'none') AS annotator, count(*) AS n, count(DISTINCT data_id) AS documents FROM ({DOCS}) GROUP BY 1")
def annotator_files(spark, sf_dir):
    """A file for each language, whose name becomes the annotator."""
    folder, docs = work_folder(spark), annotated(spark, sf_dir)
    lang = F.coalesce(F.col("subjects")[0]["PIIs"][1]["keyword"], F.lit(""))
    for name in sorted(r[0] for r in docs.select(lang).distinct().collect()):  # languages
        jsonl.write_jsonl(docs.where(lang == name).coalesce(1), f"{folder}/tmp")
        as_one_file(spark, f"{folder}/tmp", f"{folder}/{name or 'none'}.jsonl")
    return jsonl.read_annotators(spark, folder).groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("metadata.data_id").alias("documents"))


@register("response_cache", "SELECT CAST(o_custkey AS VARCHAR) AS data_id, 'answer ' || o_custkey AS response FROM orders GROUP BY o_custkey")
def response_cache(spark, sf_dir):
    """Saved responses with repeated and broken lines."""
    path = f"{work_folder(spark)}/cache.jsonl"
    o = table(spark, sf_dir, "orders")
    good = o.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("data_id"), F.concat(F.lit("answer "), "o_custkey").alias("response"))).alias("value"))
    good.unionAll(o.select(F.lit("{oops")).limit(3)).write.text(path)
    return jsonl.read_cache(spark, path).select("data_id", "response")


@register("training_files", "SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, 'one' AS annotator, n_name AS span_text, CASE WHEN n_nationkey % 2 = 0 THEN 'DIRECT' ELSE 'NO_MASK' END AS identifier_type FROM nation")
def training_files(spark, sf_dir):
    """Training documents as a JSON array in one file, a row a mention."""
    folder = work_folder(spark)
    kind = F.when(F.col("n_nationkey") % 2 == 0, "DIRECT").otherwise("NO_MASK")
    mention = F.struct(kind.alias("identifier_type"), F.col("n_name").alias("span_text"), F.lit(0).alias("start_offset"), F.length("n_name").alias("end_offset"))
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.collect_list(mention).alias("m"))
    doc = F.struct("doc_id", F.lit("train").alias("dataset_type"), F.lit("t").alias("text"), F.create_map(F.lit("one"), F.struct(F.col("m").alias("entity_mentions"))).alias("annotations"))
    docs.agg(F.to_json(F.collect_list(doc)).alias("value")).coalesce(1).write.text(f"{folder}/tmp")
    as_one_file(spark, f"{folder}/tmp", f"{folder}/train.json")
    return jsonl.read_training(spark, f"{folder}/train.json").select("doc_id", "annotator", "span_text", "identifier_type")


@register("response_stages", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'sa' ELSE 'spc' END AS stage, count(*) AS n, count(DISTINCT c_name) AS names FROM customer GROUP BY 1")
def response_stages(spark, sf_dir):
    path, c = f"{work_folder(spark)}/responses", table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("data_id"), F.col("c_name").alias("response"), F.when(F.col("c_custkey") % 2 == 0, "sa").otherwise("spc").alias("stage"))
    for stage in ("sa", "spc"):
        jsonl.write_responses(rows.where(F.col("stage") == stage), path)
    return spark.read.json(path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("response").alias("names"))


@register("error_log", "SELECT CAST(s_suppkey AS VARCHAR) AS data_id, 'PARSE' AS error_type, s_name AS error, true AS dated FROM supplier WHERE s_acctbal < 5000")
def error_log(spark, sf_dir):
    path = f"{work_folder(spark)}/errors.jsonl"
    bad = table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").cast("string").alias("data_id"), F.col("s_name").alias("error"))
    jsonl.write_jsonl(jsonl.errors(bad, "PARSE"), path, append=True)
    rows = spark.read.schema(schemas.ERROR_LOG).json(path)
    return rows.select("data_id", "error_type", "error", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$").alias("dated"))


@register("case_log_file", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey, n_name) AS INT) AS line, n_name AS log FROM nation JOIN region ON n_regionkey = r_regionkey")
def case_log_file(spark, sf_dir):
    """Case lines in order of their group, as the file has them."""
    path = f"{work_folder(spark)}/cases"
    jsonl.write_case_log(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("case_group"), F.col("n_name").alias("log")), path)
    lines = spark.read.text(path).select(F.col("value").alias("log"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    return lines.select(F.row_number().over(Window.orderBy("file", "at")).alias("line"), "log")


@register("split_files", "SELECT CASE WHEN quality = 1 THEN 'agreed' ELSE 'conflict' END AS part, count(*) AS n, sum(doc_id) AS ids FROM labels GROUP BY 1")
def split_files(spark, sf_dir):
    folder = work_folder(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "agreed").otherwise("conflict").alias("part"))
    jsonl.split_by_part(rows, f"{folder}/agreed", f"{folder}/conflict")
    read = [spark.read.schema("doc_id long").json(f"{folder}/{name}").withColumn("part", F.lit(name)) for name in ("agreed", "conflict")]
    return read[0].unionAll(read[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@register("text_to_analyse", f"SELECT data_id, coalesce(anonymized_text, text) AS anonymized, text AS plain FROM ({DOCS})")
def text_to_analyse(spark, sf_dir):
    d = annotated(spark, sf_dir)
    return d.select("metadata.data_id", jsonl.text_column(d, "x/anonymized/y.jsonl").alias("anonymized"), jsonl.text_column(d, "x/y.jsonl").alias("plain"))


@register("short_id_check", "SELECT count(*) AS n, count(*) AS kinds, 5 AS shortest, 5 AS longest FROM customer")
def short_id_check(spark, sf_dir):
    ids = jsonl.short_ids(spark, table(spark, sf_dir, "customer").count())
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("kinds"), F.min(F.length("id")).alias("shortest"), F.max(F.length("id")).alias("longest"))


@register("first_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 10")
def first_documents(spark, sf_dir):
    """A top-k report: the first ten documents."""
    return jsonl.first_documents(table(spark, sf_dir, "documents").where("doc_id is not null"), 10, "doc_id").select("doc_id", "lang")


@register("run_summary", "SELECT event_type AS status, count(*) AS documents FROM events GROUP BY 1")
def run_summary(spark, sf_dir):
    return stats.run_summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"))


@register("missing_texts", f"SELECT data_id, 'missing anonymized text' AS error FROM ({DOCS}) WHERE anonymized_text IS NULL")
def missing_texts(spark, sf_dir):
    return utility.missing_texts(annotated(spark, sf_dir).select("metadata.data_id", "text", "anonymized_text"))


@register("align_errors", "SELECT CAST(c_custkey AS VARCHAR) AS data_id, 'missing annotations' AS error FROM customer WHERE c_custkey % 4 = 0")
def align_errors(spark, sf_dir):
    person = F.array(F.lit("x"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("data_id"), person.alias("annotation_A"), F.when(F.col("c_custkey") % 4 != 0, person).when(F.col("c_custkey") % 8 == 0, F.array().cast("array<string>")).alias("annotation_B"))
    return evaluate.align_errors(c)


@register("blank_piis", f"SELECT data_id, unnest(['NAME', 'AGE']) AS tag, '' AS keyword, 0 AS certainty FROM ({DOCS})")
def blank_piis(spark, sf_dir):
    d = annotated(spark, sf_dir).select("metadata.data_id", F.explode(alignment.blank_piis(F.col("subjects")[0]["PIIs"])).alias("p"))
    return d.select("data_id", "p.tag", "p.keyword", "p.certainty")


@register("cached_call", "SELECT CAST(c_custkey AS VARCHAR) AS data_id, 'success' AS status, CASE WHEN c_custkey % 3 = 0 THEN 'saved ' ELSE 'asked ' END || c_name AS response FROM customer")
def cached_call(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("data_id"), F.col("c_name").alias("prompt"))
    saved = c.where(F.col("data_id").cast("long") % 3 == 0).select("data_id", F.concat(F.lit("saved "), "prompt").alias("response"))
    return backends.cached_call(c, saved, backends.Stub(lambda p: "asked " + p)).select("data_id", "status", "response")


@register("without_fences", "SELECT s_suppkey, s_name AS answer FROM supplier")
def without_fences(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", parse.without_fences(F.concat(F.lit("```JSON\n"), "s_name", F.lit("\n```"))).alias("answer"))


BIO = "SELECT l_orderkey AS data_id, l_linenumber AS pos, CASE min(l_returnflag) WHEN 'N' THEN 'O' WHEN 'R' THEN 'B-MASK' ELSE 'I-MASK' END AS bio FROM lineitem GROUP BY l_orderkey, l_linenumber"


@register(
    "bio_decode",
    f"""WITH t AS (SELECT *, lag(bio) OVER (PARTITION BY data_id ORDER BY pos) AS before FROM ({BIO})),
    n AS (SELECT *, sum(CASE WHEN bio = 'B-MASK' OR (bio = 'I-MASK' AND (before IS NULL OR before = 'O')) THEN 1 ELSE 0 END) OVER (PARTITION BY data_id ORDER BY pos) AS run FROM t)
    SELECT data_id, 'MASK' AS label, CAST(min(pos) * 10 AS INT) AS start_offset, CAST(max(pos) * 10 + 9 AS INT) AS end_offset FROM n WHERE bio <> 'O' GROUP BY data_id, run""",
)
def bio_decode(spark, sf_dir):
    """Tags that line items stand for, decoded to spans."""
    flag, lines = F.col("flag"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    tokens = lines.select(F.col("l_orderkey").alias("data_id"), F.col("l_linenumber").alias("pos"), F.when(flag == "N", "O").when(flag == "R", "B-MASK").otherwise("I-MASK").alias("bio"))
    tokens = tokens.withColumn("start_offset", (F.col("pos") * 10).cast("int")).withColumn("end_offset", (F.col("pos") * 10 + 9).cast("int"))
    return spans.bio_spans(tokens).select("data_id", "label", "start_offset", "end_offset")


@register(
    "analysis_text",
    """SELECT c_custkey AS data_id, CASE c_custkey % 4 WHEN 0 THEN 'Individual Character Analysis - ' || c_name || ' The Number of Subjects: 3 and more' WHEN 1 THEN 'The Number  of Subjects: 3' WHEN 2 THEN 'Number of Subjects: 2 then Individuals Identified: ' || c_name ELSE 'nobody ' || c_name END AS analysis,
    CASE WHEN c_custkey % 4 = 3 THEN 'error' ELSE 'success' END AS status FROM customer""",
)
def analysis_text(spark, sf_dir):
    """The part of an answer that analyses people, as text."""
    form = F.col("c_custkey") % 4
    answer = (
        F.when(form == 0, F.concat(F.lit("Sure.\n**Individual Character Analysis**\n- "), "c_name", F.lit("\nThe Number of Subjects: 3 and more")))
        .when(form == 1, F.lit("I say: The Number  of Subjects: 3"))
        .when(form == 2, F.concat(F.lit("So Number of Subjects: 2 then\nIndividuals Identified: "), "c_name"))
        .otherwise(F.concat(F.lit("nobody\n"), "c_name"))
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), parse.analysis_part(answer).alias("p")).select("data_id", F.col("p.text").alias("analysis"), "p.status")


@register(
    "clean_json",
    """SELECT s_suppkey, '[{"id": 0, "PIIs": [{"tag":"NAME", "keyword": "' || s_name || '"}]}, {"id": 1, "PIIs": [{"tag":"AGE", "keyword": "4"}]}]' AS cleaned FROM supplier""",
)
def clean_json(spark, sf_dir):
    """Answers whose people are put together wrongly in twelve ways."""
    seams = ('}]}], [{"id"', '}]}]{"id"', '}]],[{"id"', '}]], {"id"', '}}][{"id"', '}}),{"id"', '}}, {"id"', '}},{"id"', '}],{"id"', '}]},{["id"', '}],{{"id"', '}]}, {"id"')
    seam = F.element_at(F.array(*map(F.lit, seams)), (F.col("s_suppkey") % len(seams) + 1).cast("int"))
    tail = F.lit(' 1, "PIIs": [{"tag":"AGE", "keyword": "4"}]}]\n... ')
    answer = F.concat(F.lit('[{"id": 0, "PIIs": [{tag:"NAME", "keyword": "'), "s_name", F.lit('"'), seam, F.lit(":"), tail)
    return table(spark, sf_dir, "supplier").select("s_suppkey", repair.clean_json_udf(answer).alias("cleaned"))


@register("profile_repair", "SELECT s_suppkey AS data_id, s_suppkey % 3 = 0 AS repaired, 'success' AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'mended' ELSE s_name END AS keyword FROM supplier")
def profile_repair(spark, sf_dir):
    """Answers that no repair can read go to a model once."""
    good = F.concat(F.lit('[{"id": 0, "PIIs": [{"tag": "NAME", "keyword": "'), "s_name", F.lit('"}]}]'))
    answers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit('[{"id" 0 "PIIs" NAME ((')).otherwise(good).alias("response"))
    got = infer.with_repair(answers, backends.Stub(lambda p: '[{"id": 0, "PIIs": [{"tag": "NAME", "keyword": "mended"}]}]'))
    return got.select("data_id", "repaired", "parsed.status", F.col("parsed.subjects")[0]["PIIs"][0]["keyword"].alias("keyword"))


@register(
    "profile_rekey_rivals",
    "SELECT p_partkey AS data_id, unnest([0, 1, 2]) AS subject_id, 'NAME' AS tag, unnest(['seven', 'eight', 'nine']) AS keyword FROM part",
)
def profile_rekey_rivals(spark, sf_dir):
    """Three people whose descriptions rival: ids are served in ascending order."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("data_id"))
    rows = lambda *people: p.select("data_id", F.explode(F.array(*(F.struct(F.lit(i).alias("subject_id"), F.lit(d).alias("description"), F.lit(k).alias("keyword")) for i, d, k in people))).alias("r")).select("data_id", "r.*").withColumn("tag", F.lit("NAME")).withColumn("certainty", F.lit(3)).withColumn("hardness", F.lit(1))
    first = rows((0, "tall man shop", ""), (1, "tall man shop owner", ""), (2, "old tall man shop owner", ""))
    second = rows((7, "tall man shop owner", "seven"), (8, "tall man shop owner old", "eight"), (9, "a tall old man shop owner", "nine"))
    return infer.rekeyed(first, second).select("data_id", "subject_id", "tag", "keyword")


@register("stream_equals_batch", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_equals_batch(spark, sf_dir):
    """Events delivered twice as files, each kept once by a stream, written by an idempotent sink and counted."""
    folder, events = work_folder(spark), table(spark, sf_dir, "events")
    for n in (0, 1):
        events.write.parquet(f"{folder}/in/part={n}")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
    seen = incremental.once_each(stream, "event_id", "ts", "4000 days")
    incremental.run(seen, lambda batch: batch.select("event_type", "value"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("json_array_ranges", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, n_chars, doc_id % 8 AS file FROM documents")
def json_array_ranges(spark, sf_dir):
    """Documents as eight files of one JSON array each, whose strings hold brackets, quotes and backslashes, read by ranges of 64 KB."""
    d = table(spark, sf_dir, "documents")
    odd = F.concat(F.lit('{"[\\},]'), F.coalesce("text", F.lit("")), F.lit('\\\\"]'))
    lines = d.select((F.col("doc_id") % 8).alias("file"), F.lit(1).alias("part"), F.to_json(F.struct("doc_id", odd.alias("text"), "lang", "n_chars", F.array(F.struct(F.lit("},{").alias("k"))).alias("more"))).alias("line"))
    frame = spark.range(8).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("[").alias("line")), F.struct(F.lit(2).alias("part"), F.lit('{"doc_id": null}]').alias("line")))).alias("x")).select("file", "x.*")
    body = lines.withColumn("line", F.concat("line", F.lit(" ,"))).unionByName(frame)
    folder = work_folder(spark)
    body.repartition(8, "file").sortWithinPartitions("file", "part").select("line", "file").write.partitionBy("file").text(f"{folder}/arrays")
    rows = read_json_array(spark, f"{folder}/arrays/*", "doc_id long, text string, lang string, n_chars long", split=1 << 16)
    inner = F.substring("text", 8, F.length("text") - 11)
    return rows.where("doc_id is not null").select("doc_id", F.sha2(inner, 256).alias("text_sha256"), "lang", "n_chars", (F.col("doc_id") % 8).alias("file"))
