"""Registered queries of smaller parts: runs of two annotators, chosen tags, reports, prompts, numbered entities, kinds of collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import backends, prompts
from veilframe.functions import parse
from veilframe.operators import entities, scoring, spans
from veilframe.plans import evaluate, utility
from veilframe.queries import EV_COLUMNS, ORACLES, ann, register, table, with_ev
from veilframe.queries_files import annotated
from veilframe.sources import jsonl
from veilframe.sources.folders import as_one_file, work_folder


@register(
    "annotators_run",
    f"""SELECT 'class' AS kind, case_class AS name, n FROM ({ORACLES["case_classes"]})
    UNION ALL SELECT 'part', part, count(*) FROM ({ORACLES["consensus_split"]}) GROUP BY part
    UNION ALL SELECT 'evaluations', CAST(agreement_score AS VARCHAR), count(*) FROM ({ORACLES["inter_evaluations"]}) GROUP BY 2
    UNION ALL SELECT 'subjects', 'matched', count(*) FILTER (i = 0) FROM (SELECT unnest([0, 1]) AS i FROM region)""",
)
def annotators_run(spark, sf_dir):
    """A whole run over two annotators: classes of its cases, parts of the consensus, scores, matched subjects."""
    a, b = ann(spark, sf_dir)
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("data_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    aligned = r.select("data_id", F.col("idx").alias("subject_id"), (F.col("idx") == 0).alias("matched"), F.when(F.col("idx") > 0, "A").alias("unmatched_side"))
    run = evaluate.evaluate_annotators(a, b, aligned, min_certainty=2)
    n = F.count(F.lit(1)).alias("n")
    of = lambda df, kind, name: df.groupBy(name.alias("name")).agg(n).select(F.lit(kind).alias("kind"), "name", "n")
    out = of(run["classes"], "class", F.col("case_class")).unionByName(of(run["agreed"], "part", F.col("part"))).unionByName(of(run["evaluations"], "evaluations", F.col("agreement_score").cast("string")))
    return out.unionByName(run["subjects"].select(F.lit("subjects").alias("kind"), F.lit("matched").alias("name"), F.col("matched_subjects").alias("n")))


@register("chosen_tags", with_ev(f"SELECT {EV_COLUMNS} FROM ev WHERE tag IN ('NAME', 'AGE')"))
def chosen_tags(spark, sf_dir):
    """Evaluations of two tags only."""
    return scoring.gt_evaluations(*ann(spark, sf_dir), tags=("NAME", "AGE"))


@register("single_report", "SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS region FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey)")
def single_report(spark, sf_dir):
    """One report of every nation's first customer, written and read by its path."""
    folder = work_folder(spark)
    first = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("c_name"))
    one = first.agg(F.map_from_entries(F.collect_list(F.struct("c_name", F.col("c_nationkey").cast("string")))).alias("config")).withColumn("detailed_results", F.array().cast("array<int>"))
    jsonl.write_report(one, f"{folder}/tmp")
    as_one_file(spark, f"{folder}/tmp", f"{folder}/report.json")
    return jsonl.read_reports(spark, f"{folder}/report.json").select(F.explode("config").alias("name", "region"))


@register(
    "numbered_entities",
    """SELECT c_custkey AS data_id, unnest(['1', '2']) AS span_id, unnest([c_name, 'T-' || c_custkey]) AS span_text, unnest(['PERSON', 'CODE']) AS entity_type, 'direct' AS identifier_type FROM customer""",
)
def numbered_entities(spark, sf_dir):
    """A customer's name and phone as entities, beside an empty span and one that ends at 0."""
    c = table(spark, sf_dir, "customer")
    rows = F.array(*(F.struct(t.alias("span_text"), F.lit(s).alias("start_offset"), F.lit(e).alias("end_offset")) for t, s, e in ((F.concat(F.lit("T-"), "c_custkey"), 40, 55), (F.col("c_name"), 3, 21), (F.lit(""), 1, 1), (F.lit("x"), 0, 0))))
    got = spans.tab_entities(c.select(F.col("c_custkey").alias("data_id"), F.explode(rows).alias("s")).select("data_id", "s.*"))
    return got.where("span_id = entity_id").select("data_id", "span_id", "span_text", "entity_type", "identifier_type")


@register("trimmed_spans", "SELECT c_custkey AS data_id, c_name AS span_text, CAST(12 + c_custkey % 2 AS INT) AS start_offset, CAST(12 + c_custkey % 2 + length(c_name) AS INT) AS end_offset FROM customer")
def trimmed_spans(spark, sf_dir):
    """Names between marks and blanks, beside mentions that only number a list."""
    edge = F.when(F.col("c_custkey") % 2 == 0, F.lit("(\"")).otherwise(F.lit(" \n'"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.explode(F.array(F.concat(edge, "c_name", F.lit('")., ')), F.lit("1."), F.lit("(a)"), F.lit("iv)"))).alias("span_text"))
    kept = entities.drop_enumerators(c)
    return kept.select("data_id", spans.trim_span(F.col("span_text"), F.lit(10)).alias("s")).select("data_id", "s.*")


@register(
    "asked_prompts",
    """SELECT s_suppkey AS data_id, 'Answer yes, less precise or no.' || chr(10) || 'NAME: ''' || s_name || ''' and ''' || s_nationkey || '''' AS agreement, s_name || ' of ' || s_nationkey AS counted FROM supplier""",
)
def asked_prompts(spark, sf_dir):
    """What the prompts for an opinion on two values and for a count of people end with."""
    s = table(spark, sf_dir, "supplier")
    agree = prompts.agree(F.col("s_name"), F.col("s_nationkey").cast("string"), F.lit("NAME"), truth=True)
    count = prompts.count_people(F.concat("s_name", F.lit(" of "), "s_nationkey"), "tab")
    tail = lambda c, mark: F.concat(F.lit(mark), F.get(F.split(c, mark, 2), F.lit(1)))
    return s.select(F.col("s_suppkey").alias("data_id"), tail(agree, "Answer yes").alias("agreement"), F.get(F.split(count, "Text:\n", 2), F.lit(1)).alias("counted"))


@register("dataset_paths", "SELECT c_custkey AS data_id, CASE WHEN c_custkey % 2 = 0 THEN 'panorama' ELSE 'tab' END AS dataset FROM customer")
def dataset_paths(spark, sf_dir):
    """The dataset that a path names; both of a run's paths have to name the same one."""
    if jsonl.same_dataset("/in/TAB/gold.jsonl", "/out/tab_x.jsonl") != "tab":
        raise AssertionError
    path = F.concat(F.lit("/data/"), F.when(F.col("c_custkey") % 2 == 0, "PANORAMA").otherwise("tab"), F.lit("/"), "c_name", F.lit(".jsonl"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), parse.strict_dataset(path).alias("dataset"))


@register(
    "collection_kinds",
    "SELECT unnest(['texts', 'nulls', 'mixed']) AS name, unnest([false, false, count(*) FILTER (doc_id % 3 = 0 AND lang IS NOT NULL) > 0]) AS anonymized, count(*) AS documents FROM documents WHERE doc_id IS NOT NULL",
)
def collection_kinds(spark, sf_dir):
    """Whether a collection has anonymized texts: without the column, with nulls only, with some."""
    d = annotated(spark, sf_dir)
    out = None
    for name, df in (("texts", d.drop("anonymized_text")), ("nulls", d.withColumn("anonymized_text", F.lit(None).cast("string"))), ("mixed", d)):
        row = df.agg(F.count(F.lit(1)).alias("documents")).select(F.lit(name).alias("name"), F.lit(jsonl.is_anonymized(df)).alias("anonymized"), "documents")
        out = row if out is None else out.unionByName(row)
    return out


@register("failed_subjects", "SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS data_id, 0 AS subject_id, 'AGE' AS tag, 'old' AS keyword_a, '30-40' AS keyword_b FROM orders WHERE o_orderkey % 4 = 1")
def failed_subjects(spark, sf_dir):
    """Orders as documents; an age that can't be read beside a range fails its subject."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("data_id"), (F.col("o_orderkey") % 4).alias("k"))
    side = lambda v: o.select("data_id", F.lit(0).alias("subject_id"), F.lit("AGE").alias("tag"), F.lit(0).alias("pos"), v.alias("keyword"), F.lit(3).alias("certainty"), F.lit(1).alias("hardness"))
    a, b = side(F.when(F.col("k") == 1, "old").otherwise("35")), side(F.lit("30-40"))
    return scoring.failed_subjects(scoring.gt_evaluations(a, b, keep_errors=True))


@register(
    "judged_run",
    """SELECT 'judged' AS kind, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part UNION ALL SELECT 'judge', count(*) FILTER (p_partkey % 3 = 1) FROM part UNION ALL SELECT 'missing_text', count(*) FILTER (p_partkey % 3 = 2) FROM part
    UNION ALL SELECT 'samples', count(*) FILTER (p_partkey % 3 < 2) FROM part UNION ALL SELECT 'readable', count(*) FILTER (p_partkey % 3 = 0) * 8 FROM part""",
)
def judged_run(spark, sf_dir):
    """Utility of parts' names with a judge that answers for a third, fails for a third, and a third without an anonymized text."""
    p = table(spark, sf_dir, "part")
    form = F.col("p_partkey") % 3
    docs = p.select(F.col("p_partkey").alias("data_id"), F.concat_ws(" ", F.when(form == 1, "down"), "p_name", "p_type").alias("text"), F.when(form < 2, F.concat_ws(" ", "p_name", F.lit("redacted"))).alias("anonymized_text"))

    def answer(prompt):
        if "Original:\ndown" in prompt:
            raise OSError("down")
        return '{"readability": {"score": 8}, "meaning": {"score": 6}, "hallucinations": {"score": 1}}'

    run = utility.evaluate(docs, backends.Stub(answer))
    n = F.count(F.lit(1)).alias("n")
    counted = run["errors"].groupBy(F.col("error_type").alias("kind")).agg(n)
    judged = run["scores"].where("utility_model = 0.7").agg(F.lit("judged").alias("kind"), n)
    total = run["summary"].select(F.lit("samples").alias("kind"), F.col("num_samples").alias("n"))
    readable = run["scores"].agg(F.lit("readable").alias("kind"), F.sum("readability").cast("long").alias("n"))
    return counted.unionByName(judged).unionByName(total).unionByName(readable)


@register(
    "model_decisions",
    "SELECT CAST(o_orderkey AS BIGINT) AS data_id, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS agreement_score, 'MODEL' AS evaluation_method FROM orders",
)
def model_decisions(spark, sf_dir):
    """Orders as documents whose occupations differ: a model says yes, less precise, or fails."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("data_id"), (F.col("o_orderkey") % 3).alias("k"))
    side = lambda v: o.select("data_id", F.lit(0).alias("subject_id"), F.lit("OCCUPATION").alias("tag"), F.lit(0).alias("pos"), v.alias("keyword"), F.lit(3).alias("certainty"), F.lit(1).alias("hardness"))
    a, b = side(F.concat(F.lit("baker "), "k")), side(F.lit("cook"))

    def answer(prompt):
        if "baker 2" in prompt:
            raise OSError("down")
        return "Yes." if "baker 0" in prompt else "Less precise"

    pairs = a.join(b.select("data_id", F.col("keyword").alias("keyword_b")), "data_id").withColumnRenamed("keyword", "keyword_a")
    decisions = evaluate.decide(scoring.rule_scores(pairs), backends.Stub(answer))
    return scoring.gt_evaluations(a, b, decisions=decisions).select("data_id", "agreement_score", "evaluation_method")
