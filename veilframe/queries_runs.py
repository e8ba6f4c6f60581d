"""Registered queries of whole runs: alignment with its failures and counts, profiles alone, paraphrases, a tagger's corrections."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilframe import backends, schemas
from veilframe.functions import text as tx
from veilframe.operators import alignment, entities, stats
from veilframe.operators import counts as counting
from veilframe.plans import anonymize, evaluate, infer
from veilframe.queries import register, table
from veilframe.queries_documents import PAIR, pairs, subjects
from veilframe.sources import release
from veilframe.sources.folders import work_folder, written
from veilframe.sources.ledger import Ledger
from veilframe.streaming import retries


def joined(df, *names):
    """Arrays of ids as text, which both engines compare alike."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@register(
    "match_stats",
    f"""WITH {PAIR}, g AS (SELECT sa.data_id, 'A' AS side, sa.idx, sa.id, pos IS NOT NULL AS hit FROM sa LEFT JOIN pr ON sa.data_id = pr.data_id AND sa.idx = pr.a_idx UNION ALL SELECT data_id, 'B', idx, id, l_tax > 0.02 FROM sb)
    SELECT data_id, count(*) FILTER (side = 'A') AS gt_subjects, count(*) FILTER (side = 'B') AS llm_subjects, count(*) FILTER (side = 'A' AND hit) AS matched, 2 * count(*) FILTER (side = 'A' AND NOT hit) AS gt_only_piis,
      count(*) FILTER (side = 'B' AND NOT hit) AS llm_only_piis, coalesce(string_agg(id, ',' ORDER BY idx) FILTER (side = 'A' AND NOT hit), '') AS gt_only_ids, coalesce(string_agg(id, ',' ORDER BY idx) FILTER (side = 'B' AND NOT hit), '') AS llm_only_ids FROM g GROUP BY data_id""",
)
def match_stats(spark, sf_dir):
    """What each order's alignment matched, with two values a subject of the ground truth and one of the model's."""
    a, b = subjects(spark, sf_dir)
    value = lambda d, side, *more: d.select("data_id", F.lit(side).alias("side"), "idx", F.explode(F.array(F.col("description"), *map(F.lit, more))).alias("keyword"))
    values = value(a, "A", " ", "x", "\t").unionByName(value(b, "B", ""))
    return joined(stats.match_stats(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b), values), "gt_only_ids", "llm_only_ids")


def saved(spark, sf_dir):
    """Saved alignments of customers: in error, without ``matched``, without ids, without subjects."""
    body = (
        '"status": "error", "subjects": [{"id": 0, "matched": true}]',
        '"subjects": [{"id": 3, "PIIs": {"annotation_A": [{"keyword": "a"}, {"keyword": " "}], "annotation_B": [{"keyword": " "}]}}, {"id": 4, "PIIs": {"annotation_A": [{"keyword": "a"}], "annotation_B": [{"keyword": "x"}]}}]',
        '"subjects": [{"matched": false, "PIIs": {"annotation_A": [{"keyword": "a"}, {"keyword": "b"}, {}]}}, {"id": 1, "matched": true}]',
        '"subjects": []',
    )
    form = F.element_at(F.array(*map(F.lit, body)), (F.col("c_custkey") % 4 + 1).cast("int"))
    line = F.concat(F.lit('{"metadata": {"data_id": "'), "c_custkey", F.lit('"}, '), form, F.lit("}"))
    return table(spark, sf_dir, "customer").select(F.from_json(line, schemas.ALIGNED_DOC).alias("d")).select("d.*")


@register(
    "saved_match_stats",
    "SELECT CAST(c_custkey AS VARCHAR) AS data_id, 2 AS gt_subjects, 1 AS llm_subjects, 1 AS matched, c_custkey % 4 AS gt_only_piis, 0 AS llm_only_piis, CASE c_custkey % 4 WHEN 1 THEN '3' ELSE '0' END AS gt_only_ids, '' AS llm_only_ids FROM customer WHERE c_custkey % 4 IN (1, 2)",
)
def saved_match_stats(spark, sf_dir):
    return joined(stats.saved_match_stats(saved(spark, sf_dir)), "gt_only_ids", "llm_only_ids")


def alignment_run(spark, sf_dir):
    """A run over customers: without annotations, with a failed or no answer, with a matched or an unmatched pair; every seventh was done before."""
    c, form = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    pii = lambda tag, word: F.struct(F.lit(tag).alias("tag"), F.lit(word).alias("keyword"), F.lit(3).alias("certainty"), F.lit(1).alias("hardness"))
    person = lambda i, *values: F.struct(F.lit(i).alias("id"), F.lit("someone").alias("description"), F.array(*values).alias("PIIs"))
    a = F.array(person("0", pii("NAME", "n"), pii("AGE", " ")), person("1", pii("NAME", "n"), pii("AGE", " ")))
    b = F.array(person("0", pii("NAME", "n"), pii("AGE", "9")))
    data_id = F.col("c_custkey").cast("string").alias("data_id")
    combined = c.select(data_id, F.col("c_name").alias("text"), a.alias("annotation_A"), F.when(form == 0, F.slice(b, 1, 0)).otherwise(b).alias("annotation_B"))
    said = F.when(form == 1, "down").when(form == 3, "Same.\nResult: Matched\nSubject: A_0; B_0\n").otherwise("Other.\nResult: Unmatched\nSubject: A_0; B_0\n")
    answers = c.where(~form.isin(0, 2)).select(data_id, F.when(form == 1, "error").otherwise("success").alias("status"), said.alias("response"))
    return evaluate.run_alignment(combined, answers, c.where("c_custkey % 7 = 0").select(data_id))


TODO = "FROM customer WHERE c_custkey % 7 <> 0"


@register("alignment_run_errors", f"SELECT CAST(c_custkey AS VARCHAR) AS data_id, CASE c_custkey % 5 WHEN 0 THEN 'missing_annotations' ELSE 'alignment' END AS error_type, CASE c_custkey % 5 WHEN 0 THEN 'missing annotations' WHEN 1 THEN 'down' ELSE 'no answer' END AS error {TODO} AND c_custkey % 5 < 3")
def alignment_run_errors(spark, sf_dir):
    return alignment_run(spark, sf_dir)["errors"]


@register("alignment_run_aligned", f"SELECT CAST(c_custkey AS VARCHAR) AS data_id, CAST(i AS INT) AS subject_id, c_custkey % 5 = 3 AND i = 0 AS matched FROM (SELECT c_custkey, unnest([0, 1]) AS i {TODO} AND c_custkey % 5 > 2)")
def alignment_run_aligned(spark, sf_dir):
    return alignment_run(spark, sf_dir)["aligned"].select("data_id", "subject_id", "matched")


@register(
    "alignment_run_totals",
    f"""WITH n AS (SELECT count(*) FILTER (c_custkey % 5 = 3) AS y, count(*) FILTER (c_custkey % 5 = 4) AS z, count(*) FILTER (c_custkey % 5 < 3) AS f, count(*) AS w {TODO})
    SELECT y + z AS documents, 3 * (y + z) AS subjects_of_both, 2 * y + 3 * z AS distinct_subjects, 2 * w AS gt_subjects, y AS matched_subjects, 2 * w - y AS gt_only_subjects, 2 * w - y AS gt_only_piis, z AS llm_only_subjects, 2 * z AS llm_only_piis, w AS docs_with_gt_only,
      round(y / (2.0 * w), 4)::DOUBLE AS match_ratio, round((2 * w - y) / (2.0 * w), 4)::DOUBLE AS gt_miss_ratio, round(y / (y + z)::DOUBLE, 2) AS avg_matched_per_doc FROM n""",
)
def alignment_run_totals(spark, sf_dir):
    return alignment_run(spark, sf_dir)["totals"]


@register(
    "profile_fallback_ids",
    """SELECT s_suppkey AS data_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [5, 5, 7] ELSE [0, 1] END) AS subject_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['EMAIL_ADDRESS', 'NAME', 'NAME'] ELSE ['NAME', 'NAME'] END) AS tag,
    unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['m@x.org', s_name, 'Anna'] ELSE [s_name, 'Anna'] END) AS keyword FROM supplier""",
)
def profile_fallback_ids(spark, sf_dir):
    """Two people, of whom the profile without codes is all there is for odd suppliers: their places become their ids."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), "s_name")
    answer = F.concat(F.lit('[{"id": 5, "description": "a seller", "PIIs": [{"tag": "NAME", "keyword": "'), "s_name", F.lit('", "certainty": 3, "hardness": 1}]}, {"id": 7, "description": "a friend", "PIIs": [{"tag": "NAME", "keyword": "Anna", "certainty": 3, "hardness": 1}]}]'))
    code = F.lit('[{"id": 5, "description": "a seller", "PIIs": [{"tag": "EMAIL_ADDRESS", "keyword": "m@x.org", "certainty": 3, "hardness": 1}]}]')
    free = infer.long_profiles(s.select("data_id", answer.alias("response")))
    return infer.merged_profiles(infer.long_profiles(s.where("data_id % 2 = 0").select("data_id", code.alias("response"))), free).select("data_id", "subject_id", "tag", "keyword")


@register("paraphrase_limit", "SELECT c_custkey AS data_id, CAST(floor(floor((c_custkey % 90) / 2) * 1.5) AS INT) + 50 AS words FROM customer")
def paraphrase_limit(spark, sf_dir):
    """Paraphrases of texts of 0 to 89 characters by a model that never stops."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.expr("repeat('x', CAST(c_custkey % 90 AS INT))").alias("text"))
    got = anonymize.by_model(docs, backends.Stub(lambda p: "w " * 500), "paraphrase")
    return got.select("data_id", F.size(F.split("anonymized_text", " ")).alias("words"))


#: Texts by number: what stands before, in and after the mention, its label, by how much either border moves, its type.
TAGGED = (
    ("Then Mr. ", "{}", " spoke.", "PERSON", -4, 0, "PERSON"),
    ("paid USD ", "500", " million to them", "CARDINAL", -4, 8, "QUANTITY"),
    ("on 12 ", "March 2001", " here", "DATE", -3, 0, "DATETIME"),
    ("the Kingdom of ", "Spain", " won", "GPE", -11, 0, "ORG"),
    ("born in ", "Spain", "", "GPE", 0, 0, "LOC"),
    ("against ", "Spain", ".", "GPE", 0, 0, "ORG"),
    ("Here ", "{}'s", " house", "PERSON", 0, -2, "PERSON"),
    ("", "1.", " Anna came", "PERSON", 0, 0, None),
    ("a view of ", "the Alps", "", "LOC", 4, 0, "LOC"),
    ("number ", "12345", ".", "CARDINAL", 0, 0, "CODE"),
    ("number ", "123", ".", "DATE", 0, 0, None),
    ("the ", "first", " time", "ORDINAL", 0, 0, None),
    ("moved ", "Paris to", " Rome", "GPE", 0, -3, "LOC"),
    ("for €", "20", "", "MONEY", -1, 0, "QUANTITY"),
)


def _tagged_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("{}", "' || c_name || '") + "'"
    rows = [f"SELECT c_custkey AS data_id, CAST({len(x) + l} AS INT) AS start_offset, CAST({len(x) + r} + length({quote(m)}) AS INT) AS end_offset, '{t}' AS entity_type FROM customer WHERE c_custkey % {len(TAGGED)} = {i}" for i, (x, m, _, _, l, r, t) in enumerate(TAGGED) if t]
    return " UNION ALL ".join(rows)


@register("tagger_corrections", _tagged_sql())
def tagger_corrections(spark, sf_dir):
    """A tagger's mentions in short texts with the customer's name."""
    name = lambda t: F.replace(F.lit(t), F.lit("{}"), F.col("c_name"))
    forms = F.array(*(F.struct(F.lit(x).alias("x"), name(m).alias("m"), F.lit(y).alias("y"), F.lit(label).alias("label")) for x, m, y, label, *_ in TAGGED))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.element_at(forms, (F.col("c_custkey") % len(TAGGED) + 1).cast("int")).alias("f")).select("data_id", "f.*")
    mentions = c.select("data_id", F.lit(0).alias("pos"), F.length("x").alias("start_offset"), (F.length("x") + F.length("m")).alias("end_offset"), "label")
    return entities.corrected(mentions, c.select("data_id", F.concat("x", "m", "y").alias("text")), countries=("Spain",)).drop("pos")


@register("call_ledger", "SELECT c_mktsegment || ' ' || c_nationkey AS prompt, count(*) AS customers, CASE WHEN c_nationkey % 5 = 0 THEN 2 ELSE 1 END AS calls, CASE WHEN c_nationkey % 5 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN c_nationkey % 5 = 0 THEN 'OSError: down' ELSE 'about ' || c_mktsegment || ' ' || c_nationkey END AS response FROM customer GROUP BY c_mktsegment, c_nationkey")
def call_ledger(spark, sf_dir):
    """Customers' prompts, which repeat, asked for every second customer and then for all; some always fail and get a second attempt."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("prompt"))

    def answer(p):
        if int(p.rsplit(" ", 1)[1]) % 5 == 0:
            raise OSError("down")
        return "about " + p

    ledger = Ledger(spark)
    ledger.ask(c.where("c_custkey % 2 = 0"), backends.Stub(answer), "about").count()
    told = ledger.ask(c, backends.Stub(answer), "about", attempts=2)
    calls = ledger.answers("about").groupBy("key").agg(F.count(F.lit(1)).alias("calls"))
    prompts = told.groupBy("prompt").agg(F.count(F.lit(1)).alias("customers"), F.max("status").alias("status"), F.max("response").alias("response"))
    return prompts.withColumn("key", F.sha2(F.concat(F.lit("\n"), "prompt"), 256)).join(calls, "key").drop("key")


@register("alignment_run_retries", "SELECT CAST(c_custkey AS VARCHAR) AS data_id, unnest(range(1, CASE WHEN c_custkey % 5 < 3 THEN 4 ELSE 2 END))::INT AS attempt, CASE WHEN c_custkey % 5 < 3 THEN 'error' ELSE 'success' END AS status FROM customer WHERE c_custkey % 5 > 0")
def alignment_run_retries(spark, sf_dir):
    """The passes of an aligner that always fails for some customers and gives others no result."""
    c, form = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    pii = F.array(F.struct(F.lit("NAME").alias("tag"), F.lit("n").alias("keyword"), F.lit(3).alias("certainty"), F.lit(1).alias("hardness")))
    person = F.array(F.struct(F.lit("0").alias("id"), F.lit("someone").alias("description"), pii.alias("PIIs")))
    text = F.concat(F.element_at(F.array(*map(F.lit, ("none", "down", "mumble", "same", "other"))), (form + 1).cast("int")), F.lit(" "), "c_name")
    combined = c.select(F.col("c_custkey").cast("string").alias("data_id"), text.alias("text"), person.alias("annotation_A"), F.when(form == 0, F.slice(person, 1, 0)).otherwise(person).alias("annotation_B"))

    def answer(p):
        kind = p.split("Text:\n", 1)[1].split(" ", 1)[0]
        if kind == "down":
            raise OSError("down")
        return {"same": "Result: Matched\nSubject: A_0; B_0\n", "other": "Result: Unmatched\nSubject: A_0; B_0\n"}.get(kind, "Well.")

    return evaluate.align_documents(combined, backends.Stub(answer))["passes"]


@register("retry_passes", "SELECT CAST(c_custkey AS VARCHAR) AS data_id, CAST(least(c_custkey % 5 + 1, 3) AS INT) AS attempt, CASE WHEN c_custkey % 5 < 3 THEN 'done' ELSE 'failed' END AS outcome, CASE WHEN c_custkey % 5 >= 3 THEN 'down in pass 3' END AS error_type, CASE WHEN c_custkey % 5 < 3 THEN 'about ' || c_name END AS response FROM customer")
def retry_passes(spark, sf_dir):
    """A stream of answers that fail once to four times, with state by document, in three passes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("data_id"), F.concat(F.lit("about "), "c_name").alias("prompt"))

    def ask(asked):
        good = F.col("data_id").cast("long") % 5 < F.col("attempt")
        error = F.concat(F.lit("down in pass "), "attempt")
        return asked.select("data_id", "attempt", F.when(good, "success").otherwise("error").alias("status"), F.when(~good, error).alias("error_type"), F.when(good, F.col("prompt")).alias("response"))

    return retries.run(c, ask, work_folder(spark))


PLANE = r"'[\x{10000}-\x{10FFFF}]'"


@register(
    "offset_directory",
    f"""WITH o AS (SELECT doc_id, t, CAST(unnest([length(t) * k // 7 for k in range(8)]) AS INT) AS place FROM (SELECT doc_id, coalesce(text, '') || ' 😀é' AS t FROM documents)),
    p AS (SELECT *, strlen(left(t, place))::INT AS byte, (place + len(regexp_extract_all(left(t, place), {PLANE})))::INT AS unit FROM o)
    SELECT doc_id, place, byte, unit, place AS char_of_byte, place AS char_of_unit, unit AS unit_of_byte, byte AS byte_of_unit, substr(t, place + 1, 5) AS piece_of_bytes, substr(t, place + 1, 5) AS piece_of_units FROM p""",
)
def offset_directory(spark, sf_dir):
    """Eight offsets of each document to bytes, to UTF-16 units and back, and the texts at them, by one directory a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" 😀é")).alias("t"))
    d = d.withColumn("d", tx.offset_directory(F.col("t"))).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(F.length("t") * k / 7).cast("int"))))
    here, at = F.col("d"), F.col("at")
    d = d.withColumns({"byte": tx.byte_of_char(here, at), "unit": tx.unit_of_char(here, at), "byte_end": tx.byte_of_char(here, at + 5), "unit_end": tx.unit_of_char(here, at + 5)})
    byte, unit = F.col("byte"), F.col("unit")
    return d.select(
        "doc_id", at.alias("place"), "byte", "unit", tx.char_of_byte(here, byte).alias("char_of_byte"), tx.char_of_unit(here, unit).alias("char_of_unit"), tx.unit_of_byte(here, byte).alias("unit_of_byte"), tx.byte_of_unit(here, unit).alias("byte_of_unit"),
        tx.slice_of_bytes(here, byte, F.col("byte_end")).alias("piece_of_bytes"), tx.slice_of_units(here, unit, F.col("unit_end")).alias("piece_of_units"),
    )


@register(
    "stats_merge",
    f"""WITH {PAIR}, g AS (SELECT sa.data_id, 'A' AS side, sa.idx, pos IS NOT NULL AS hit FROM sa LEFT JOIN pr ON sa.data_id = pr.data_id AND sa.idx = pr.a_idx UNION ALL SELECT data_id, 'B', idx, l_tax > 0.02 FROM sb),
    m AS (SELECT data_id, count(*) FILTER (side = 'A') AS a, count(*) FILTER (side = 'B') AS b, count(*) FILTER (side = 'A' AND hit) AS h, count(*) FILTER (side = 'A' AND NOT hit) AS x, count(*) FILTER (side = 'B' AND NOT hit) AS y FROM g GROUP BY data_id),
    o AS (SELECT *, data_id % 10 <> 0 AS ok FROM m)
    SELECT count(*) FILTER (ok) AS documents, (sum(a + b) FILTER (ok))::BIGINT AS subjects_of_both, (sum(h + x + y) FILTER (ok))::BIGINT AS distinct_subjects, sum(h + x)::BIGINT AS gt_subjects, sum(h)::BIGINT AS matched_subjects, sum(x)::BIGINT AS gt_only_subjects, sum(2 * x)::BIGINT AS gt_only_piis,
      sum(y)::BIGINT AS llm_only_subjects, sum(y)::BIGINT AS llm_only_piis, count(*) FILTER (x > 0) AS docs_with_gt_only, round(sum(h) / sum(h + x), 4) AS match_ratio, round(sum(x) / sum(h + x), 4) AS gt_miss_ratio, round(sum(h) / count(*) FILTER (ok), 2) AS avg_matched_per_doc FROM o""",
)
def stats_merge(spark, sf_dir):
    """Orders' alignments counted in three batches that share documents, one of them twice; a tenth of the orders fails, some of it at first only."""
    a, b = subjects(spark, sf_dir)
    value = lambda d, side, *more: d.select("data_id", F.lit(side).alias("side"), "idx", F.explode(F.array(F.col("description"), *map(F.lit, more))).alias("keyword"))
    values = value(a, "A", " ", "x", "\t").unionByName(value(b, "B", ""))
    folder, key = work_folder(spark), F.col("data_id")
    rows = written(stats.match_stats(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b), values), folder, "rows")
    lost, counts = key % 10 == 0, counting.Counts(spark, f"{folder}/counts")
    for batch in ("1", "2", "3", "2"):
        part = rows.where(key % 3 <= int(batch) - 1) if batch != "3" else rows
        # what fails in the second batch as well is read in the third
        fails = lost | (key % 7 == 3) if batch == "2" else lost
        counts.add(batch, part.where(~fails), part.where(fails))
    return counts.totals()


@register("release_outputs", "SELECT c_custkey AS data_id, 'agreed' AS part, CAST(count(*) OVER () AS BIGINT) AS total FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'conflict', CAST(count(*) OVER () AS BIGINT) FROM customer WHERE c_custkey % 3 = 0")
def release_outputs(spark, sf_dir):
    """Two parts and their summary as one commit; a second run that stops at its summary leaves the first one's three."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.when(F.col("c_custkey") % 3 == 0, "conflict").otherwise("agreed").alias("part"))
    root = f"{work_folder(spark)}/release"
    outputs = lambda d: {**{p: d.where(F.col("part") == p).select("data_id") for p in ("agreed", "conflict")}, "summary": d.groupBy("part").agg(F.count(F.lit(1)).alias("total"))}
    release.publish(spark, root, outputs(c))
    broken = outputs(c.where("data_id % 2 = 0")) | {"summary": c.select(F.raise_error(F.lit("stopped")).cast("string").alias("part"))}
    try:
        release.publish(spark, root, broken)
    except PySparkException as e:
        if "stopped" not in str(e):
            raise
    parts = [release.read(spark, root, p).withColumn("part", F.lit(p)) for p in ("agreed", "conflict")]
    return parts[0].unionByName(parts[1]).join(release.read(spark, root, "summary"), "part").select("data_id", "part", "total")
