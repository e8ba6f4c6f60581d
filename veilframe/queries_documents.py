"""Registered queries over collections, entities, parsers, similarity, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilframe import backends, prompts
from veilframe import fixtures as fx
from veilframe.functions import parse, repair
from veilframe.functions import text as tx
from veilframe.functions.similarity import bleu_udf, rouge1_f1, rouge_l_udf
from veilframe.operators import alignment, entities, privacy, scoring, spans, stats
from veilframe.plans import anonymize, evaluate, infer, utility
from veilframe.queries import CLASS, IEV, ORACLES, ann, evaluations, register, rounded, table, with_ev
from veilframe.schemas import FILLER_TAGS
from veilframe.streaming import incremental

# --- Joins and sets of collections ----------------------------------------------------


@register("gt_llm_inner", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def gt_llm_inner(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return alignment.inner_by_id(docs, table(spark, sf_dir, "labels"), "doc_id", ("", ""))


@register("missing_in_llm_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_in_llm_anti(spark, sf_dir):
    return alignment.split_matched(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")[1]


@register("missing_in_gt_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_in_gt_anti(spark, sf_dir):
    return alignment.resume(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("common_ids_intersect", "SELECT l_suppkey AS suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def common_ids_intersect(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey")).intersect(table(spark, sf_dir, "supplier").select("s_suppkey"))


@register("ids_with_side", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'B' WHEN b.id IS NULL THEN 'A' ELSE 'both' END AS side FROM (SELECT c_custkey AS id FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS id FROM orders) b ON a.id = b.id")
def ids_with_side(spark, sf_dir):
    return alignment.with_side(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@register(
    "cross_annotator_pairs",
    "SELECT conv_id, min(role) AS annotator_a, max(role) AS annotator_b, arg_min(text, role) AS value_a, arg_max(text, role) AS value_b FROM (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id HAVING count(*) = 2",
)
def cross_annotator_pairs(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    return alignment.annotator_pairs(first, "conv_id", "role", "text")


@register("annotator_violations", "SELECT conv_id, count(*) AS n FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id HAVING count(*) <> 2")
def annotator_violations(spark, sf_dir):
    return alignment.annotator_violations(table(spark, sf_dir, "conversations").select("conv_id", "role").distinct(), "conv_id")


@register("keep_last_dedup", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def keep_last_dedup(spark, sf_dir):
    return alignment.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@register("duplicate_ids", "SELECT o_custkey, count(*) AS n, count(*) > 1 AS is_duplicate FROM orders GROUP BY o_custkey")
def duplicate_ids(spark, sf_dir):
    return alignment.duplicated(table(spark, sf_dir, "orders"), "o_custkey")


def subjects(spark, sf_dir):
    return fx.spark_view(spark, sf_dir, "subj_a"), fx.spark_view(spark, sf_dir, "subj_b")


SUBJ = f"sa AS ({fx.duck_view('subj_a')}), sb AS ({fx.duck_view('subj_b')})"


@register("subject_count_mismatch", f"WITH {SUBJ} SELECT data_id, n_a, n_b FROM (SELECT data_id, count(*) AS n_a FROM sa GROUP BY 1) JOIN (SELECT data_id, count(*) AS n_b FROM sb GROUP BY 1) USING (data_id) WHERE n_a <> n_b")
def subject_count_mismatch(spark, sf_dir):
    return alignment.count_mismatch(*subjects(spark, sf_dir), "data_id")


def responses(spark, sf_dir):
    """An aligner's answer per order: a section for each line of b, matched where its tax is above 0.02."""
    b = fx.spark_view(spark, sf_dir, "subj_b")
    verdict = F.when(F.col("l_tax") > 0.02, F.lit("Result: Matched\nSubject: A_")).otherwise(F.lit("Result: Unmatched\nSubject: A_"))
    section = F.concat(F.lit("Reasoning: same goods?\n"), verdict, F.col("a_idx").cast("string"), F.lit("; B_"), F.col("id"), F.lit("\n"))
    return b.groupBy("data_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", section.alias("s")))), lambda x: x["s"]), "---\n").alias("response"))  # at most seven lines an order


def pairs(spark, sf_dir):
    return responses(spark, sf_dir).select("data_id", F.explode(parse.alignment_pairs(F.col("response"))).alias("p")).select("data_id", "p.*")


PAIR = f"{SUBJ}, pr AS (SELECT data_id, CAST(row_number() OVER (PARTITION BY data_id ORDER BY idx) - 1 AS INT) AS pos, CAST(a_idx AS STRING) AS a_id, id AS b_id, a_idx, idx AS b_idx FROM sb WHERE l_tax > 0.02)"


@register("parse_alignment_pairs", f"WITH {PAIR} SELECT data_id, pos, a_id, b_id FROM pr")
def parse_alignment_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@register("validate_pairs", f"WITH {PAIR} SELECT data_id, pos * 2 AS pos, a_idx, b_idx FROM pr")
def validate_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    noisy = p.select("data_id", (F.col("pos") * 2).alias("pos"), F.concat(F.lit("A"), "a_id").alias("a_id"), "b_id").unionAll(p.select("data_id", (F.col("pos") * 2 + 1).alias("pos"), "a_id", F.lit("77").alias("b_id")))
    return alignment.valid_pairs(noisy, *subjects(spark, sf_dir))


@register(
    "align_gt_outer",
    f"WITH {PAIR} SELECT sa.data_id, CAST(row_number() OVER (PARTITION BY sa.data_id ORDER BY pos IS NULL, pos, sa.idx) - 1 AS INT) AS subject_id, pos IS NOT NULL AS matched, sa.idx AS a_idx, pr.b_idx, description FROM sa LEFT JOIN pr ON sa.data_id = pr.data_id AND sa.idx = pr.a_idx",
)
def align_gt_outer(spark, sf_dir):
    a, b = subjects(spark, sf_dir)
    return alignment.align_gt(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b))


FULL = f"""{PAIR}, al AS (SELECT data_id, pos, a_idx, b_idx, description, CASE WHEN pos IS NOT NULL THEN NULL WHEN a_idx IS NOT NULL THEN 'A' ELSE 'B' END AS unmatched_side FROM (
   SELECT sa.data_id, pos, sa.idx AS a_idx, pr.b_idx, description FROM sa LEFT JOIN pr ON sa.data_id = pr.data_id AND sa.idx = pr.a_idx
   UNION ALL SELECT sb.data_id, NULL, NULL, sb.idx, sb.description FROM sb WHERE l_tax <= 0.02))"""


@register("align_full_outer", f"WITH {FULL} SELECT data_id, CAST(row_number() OVER (PARTITION BY data_id ORDER BY CASE WHEN unmatched_side IS NULL THEN 0 WHEN unmatched_side = 'A' THEN 1 ELSE 2 END, pos, coalesce(a_idx, b_idx)) - 1 AS INT) AS subject_id, pos IS NOT NULL AS matched, unmatched_side, a_idx, b_idx, description FROM al")
def align_full_outer(spark, sf_dir):
    a, b = subjects(spark, sf_dir)
    return alignment.align_full(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b))


@register(
    "subject_stats",
    f"""WITH {FULL}, d AS (SELECT data_id, count(*) FILTER (unmatched_side IS NULL) AS m, count(*) FILTER (unmatched_side = 'A') AS ua, count(*) FILTER (unmatched_side = 'B') AS ub FROM al GROUP BY 1)
    SELECT count(*) AS total_documents, CAST(sum(m + ua) AS BIGINT) AS total_subjects_a, CAST(sum(m + ub) AS BIGINT) AS total_subjects_b, CAST(sum(m) AS BIGINT) AS matched_subjects, CAST(sum(ua) AS BIGINT) AS unmatched_a, CAST(sum(ub) AS BIGINT) AS unmatched_b,
      count(*) FILTER (ua <> ub) AS docs_with_subject_mismatch, CAST(sum(m + ua + ub) AS BIGINT) AS total_unique_subjects, round(sum(m) / sum(m + ua + ub)::DOUBLE, 6) AS subject_match_rate FROM d""",
)
def subject_stats(spark, sf_dir):
    a, b = subjects(spark, sf_dir)
    return rounded(stats.subject_totals(alignment.align_full(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b))), "subject_match_rate")


@register(
    "alignment_summary",
    f"""WITH {PAIR}, g AS (SELECT sa.data_id, sa.idx, pos IS NOT NULL AS matched FROM sa LEFT JOIN pr ON sa.data_id = pr.data_id AND sa.idx = pr.a_idx),
    d AS (SELECT data_id, count(*) AS s, count(*) FILTER (matched) AS h, 2 * count(*) FILTER (NOT matched) AS lost FROM g GROUP BY 1)
    SELECT CAST(sum(s) AS BIGINT) AS gt_subjects, CAST(sum(h) AS BIGINT) AS matched_subjects, CAST(sum(s - h) AS BIGINT) AS gt_only_subjects, CAST(sum(lost) AS BIGINT) AS gt_only_piis, round(sum(h) / sum(s)::DOUBLE, 6) AS match_ratio, round(sum(s - h) / sum(s)::DOUBLE, 6) AS gt_miss_ratio,
      round(avg(h), 6) AS avg_matched_per_doc, count(*) FILTER (s > h) AS docs_with_gt_only FROM d""",
)
def alignment_summary(spark, sf_dir):
    a, b = subjects(spark, sf_dir)
    g = alignment.align_gt(a, b, alignment.valid_pairs(pairs(spark, sf_dir), a, b)).select("data_id", F.col("a_idx").alias("subject_id"), "matched")
    values = a.select("data_id", F.col("idx").alias("subject_id"), F.explode(F.array(F.col("description"), F.lit(" "), F.lit("x"))).alias("keyword"))
    return rounded(stats.alignment_summary(g, values), "match_ratio", "gt_miss_ratio", "avg_matched_per_doc")


# --- Entities --------------------------------------------------------------------------


@register("mention_extract", f"SELECT * FROM {fx.duck_mentions()}")
def mention_extract(spark, sf_dir):
    return fx.spark_mentions(spark, sf_dir)


@register("entity_group", f"SELECT data_id, entity_id, arg_min(entity_type, pos) AS entity_type, coalesce(arg_min(identifier_type, pos) FILTER (identifier_type <> 'NO_MASK'), arg_min(identifier_type, pos)) AS identifier_type, count(*) AS n_mentions, count(*) FILTER (identifier_type <> 'NO_MASK') AS n_maskable FROM {fx.duck_mentions()} GROUP BY data_id, entity_id")
def entity_group(spark, sf_dir):
    return entities.group_entities(fx.spark_mentions(spark, sf_dir))


@register("span_search_mask", f"SELECT m.data_id, m.pos, m.span_text FROM {fx.duck_mentions()} m JOIN {fx.DUCK_DOCUMENTS} d USING (data_id) WHERE NOT contains(anonymized_text, span_text)")
def span_search_mask(spark, sf_dir):
    return entities.spans_by_search(fx.spark_mentions(spark, sf_dir), fx.spark_documents(spark, sf_dir)).select("data_id", "pos", "span_text")


@register("span_search_automaton", ORACLES["span_search_mask"])
def span_search_automaton(spark, sf_dir):
    """The same, each text passed once by an automaton of its document's mentions."""
    return entities.spans_by_search(fx.spark_mentions(spark, sf_dir), fx.spark_documents(spark, sf_dir), automaton=True).select("data_id", "pos", "span_text")


@register("offset_mask", f"SELECT m.data_id, m.pos, m.span_text FROM {fx.duck_mentions()} m JOIN {fx.DUCK_DOCUMENTS} d USING (data_id) WHERE length(anonymized_text) < end_offset OR substr(anonymized_text, start_offset + 1, end_offset - start_offset) <> span_text")
def offset_mask(spark, sf_dir):
    return entities.spans_by_offset(fx.spark_mentions(spark, sf_dir), fx.spark_documents(spark, sf_dir)).select("data_id", "pos", "span_text")


def recalled(spark, sf_dir):
    docs, mentions = fx.spark_documents(spark, sf_dir), fx.spark_mentions(spark, sf_dir)
    return entities.entity_recall(docs, mentions, entities.detected_masks(mentions, docs, method="span_search"))


WORDS = ", ".join(f"'{w}'" for w in (*tx.IGNORABLE_TOKENS, *tx.CLOSED_CLASS))
RECALL = f"""m AS MATERIALIZED {fx.duck_mentions()}, q AS (SELECT m.*, NOT contains(anonymized_text, span_text) AS gone, [lower(t) for t in regexp_extract_all(span_text, '[\\p{{L}}\\p{{N}}_]+')] AS tk FROM m JOIN {fx.DUCK_DOCUMENTS} d USING (data_id) WHERE identifier_type <> 'NO_MASK'),
 qm AS (SELECT data_id, entity_id, entity_type, identifier_type, gone OR len(list_filter(tk, lambda t: t NOT IN ({WORDS}))) = 0 AS ok, len(tk) AS n, CASE WHEN gone THEN len(tk) ELSE len(list_filter(tk, lambda t: t IN ({WORDS}))) END AS k, pos FROM q),
 en AS (SELECT data_id, entity_id, arg_min(entity_type, pos) AS entity_type, arg_min(identifier_type, pos) AS identifier_type, bool_and(ok) AS is_masked, sum(n) AS n_tokens, sum(k) AS n_masked_tokens FROM qm GROUP BY 1, 2)"""
TOTALS = """count(*) FILTER (identifier_type = 'DIRECT' AND is_masked) AS direct_masked, count(*) FILTER (identifier_type = 'DIRECT') AS direct_total, count(*) FILTER (identifier_type = 'QUASI' AND is_masked) AS quasi_masked, count(*) FILTER (identifier_type = 'QUASI') AS quasi_total,
 CAST(sum(n_masked_tokens) AS BIGINT) AS tokens_masked, CAST(sum(n_tokens) AS BIGINT) AS tokens_total, round(coalesce(count(*) FILTER (identifier_type = 'DIRECT' AND is_masked) / nullif(count(*) FILTER (identifier_type = 'DIRECT'), 0)::DOUBLE, 0), 6) AS erdi,
 round(coalesce(count(*) FILTER (identifier_type = 'QUASI' AND is_masked) / nullif(count(*) FILTER (identifier_type = 'QUASI'), 0)::DOUBLE, 0), 6) AS erqi, round(sum(n_masked_tokens) / sum(n_tokens)::DOUBLE, 6) AS token_recall"""


@register("erdi_erqi", f"WITH {RECALL} SELECT {TOTALS} FROM en")
def erdi_erqi(spark, sf_dir):
    return rounded(entities.recall_report(recalled(spark, sf_dir)), "erdi", "erqi", "token_recall")


@register("er_by_type", f"WITH {RECALL} SELECT entity_type, {TOTALS} FROM en GROUP BY entity_type")
def er_by_type(spark, sf_dir):
    return rounded(entities.recall_report(recalled(spark, sf_dir), by_type=True), "erdi", "erqi", "token_recall")


@register("token_recall", f"WITH {RECALL} SELECT data_id, entity_id, pos, ok AS is_masked, CAST(n AS INT) AS n_tokens, CAST(k AS INT) AS n_masked_tokens FROM qm")
def token_recall(spark, sf_dir):
    docs, mentions = fx.spark_documents(spark, sf_dir), fx.spark_mentions(spark, sf_dir)
    return entities.mention_recall(docs, mentions, entities.detected_masks(mentions, docs, method="span_search"))


SYSTEM = f"""st AS (SELECT data_id, token, CAST(s AS INT) AS start_offset, CAST(s + length(token) AS INT) AS end_offset FROM (
   SELECT data_id, hits[i] AS token, start_offset + coalesce(list_sum([length(g) for g in gaps[1:i]]), 0) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) AS s FROM (
     SELECT *, unnest(generate_series(1, len(hits))) AS i FROM (SELECT data_id, start_offset, string_split_regex(span_text, '[\\p{{L}}\\p{{N}}_]+') AS gaps, regexp_extract_all(span_text, '[\\p{{L}}\\p{{N}}_]+') AS hits FROM {fx.duck_spans(fx.REPORTED)}))))"""
COVERED = f"EXISTS (SELECT 1 FROM {fx.duck_mentions()} g WHERE g.data_id = st.data_id AND g.identifier_type <> 'NO_MASK' AND g.start_offset <= st.start_offset AND g.end_offset >= st.end_offset)"


@register("token_precision_range_semi", f"WITH {SYSTEM} SELECT data_id, token, start_offset, end_offset FROM st WHERE {COVERED}")
def token_precision_range_semi(spark, sf_dir):
    system = entities.system_tokens(fx.spark_documents(spark, sf_dir), fx.spark_spans(spark, sf_dir, fx.REPORTED))
    return entities.covered_tokens(system, fx.spark_mentions(spark, sf_dir))


@register("token_precision", f"WITH {SYSTEM} SELECT count(*) FILTER ({COVERED}) AS tp, count(*) AS total, round(count(*) FILTER ({COVERED}) / count(*)::DOUBLE, 6) AS token_precision FROM st")
def token_precision(spark, sf_dir):
    return rounded(entities.token_precision(fx.spark_documents(spark, sf_dir), fx.spark_mentions(spark, sf_dir), fx.spark_spans(spark, sf_dir, fx.REPORTED)), "token_precision")


def two_annotators(spark, sf_dir):
    """Annotator a: the gold mentions; b: the reported spans, with ends of tokens cut."""
    b = fx.spark_spans(spark, sf_dir, fx.REPORTED)
    kind = F.when(F.contains("span_text", F.lit("@")), "DIRECT").otherwise("QUASI")
    cut = F.when(F.contains("span_text", F.lit("@")) & (F.length("span_text") > 24), F.col("end_offset") - 1).otherwise(F.col("end_offset"))
    return fx.spark_mentions(spark, sf_dir), b.select("data_id", "pos", "span_text", "start_offset", cut.alias("end_offset"), F.lit("CODE").alias("entity_type"), kind.alias("identifier_type"))


NER = f"""na AS {fx.duck_mentions()}, nb AS (SELECT data_id, pos, start_offset, CASE WHEN contains(span_text, '@') AND length(span_text) > 24 THEN end_offset - 1 ELSE end_offset END AS end_offset, 'CODE' AS entity_type, CASE WHEN contains(span_text, '@') THEN 'DIRECT' ELSE 'QUASI' END AS identifier_type FROM {fx.duck_spans(fx.REPORTED)}),
 nm AS (SELECT na.data_id, na.pos AS a_pos, nb.pos AS b_pos, nb.pos IS NOT NULL AS matched, CASE WHEN na.entity_type = nb.entity_type THEN CASE WHEN na.end_offset = nb.end_offset THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS entity_type_score,
     CASE WHEN na.identifier_type = nb.identifier_type THEN CASE WHEN na.end_offset = nb.end_offset THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS identifier_type_score FROM na LEFT JOIN nb ON na.data_id = nb.data_id AND na.start_offset = nb.start_offset
   UNION ALL SELECT data_id, NULL, pos, false, 0.0, 0.0 FROM nb WHERE NOT EXISTS (SELECT 1 FROM na WHERE na.data_id = nb.data_id AND na.start_offset = nb.start_offset))"""


@register("ner_pair_match", f"WITH {NER} SELECT data_id, CAST(a_pos AS INT) AS a_pos, CAST(b_pos AS INT) AS b_pos, matched, entity_type_score, identifier_type_score FROM nm")
def ner_pair_match(spark, sf_dir):
    return entities.match_entities(*two_annotators(spark, sf_dir))


@register(
    "ner_stats",
    f"""WITH {NER} SELECT count(*) AS total_entities, count(*) FILTER (entity_type_score = 1) AS entity_type_exact, count(*) FILTER (entity_type_score > 0) AS entity_type_partial, count(*) FILTER (entity_type_score = 0) AS entity_type_mismatch,
    round(count(*) FILTER (entity_type_score = 1) / count(*)::DOUBLE, 6) AS entity_type_exact_rate, round(count(*) FILTER (entity_type_score > 0) / count(*)::DOUBLE, 6) AS entity_type_partial_rate,
    count(*) FILTER (identifier_type_score = 1) AS identifier_type_exact, count(*) FILTER (identifier_type_score > 0) AS identifier_type_partial, count(*) FILTER (identifier_type_score = 0) AS identifier_type_mismatch,
    round(count(*) FILTER (identifier_type_score = 1) / count(*)::DOUBLE, 6) AS identifier_type_exact_rate, round(count(*) FILTER (identifier_type_score > 0) / count(*)::DOUBLE, 6) AS identifier_type_partial_rate FROM nm""",
)
def ner_stats(spark, sf_dir):
    return rounded(stats.ner_stats(entities.match_entities(*two_annotators(spark, sf_dir))), *(f"{c}_type_{k}_rate" for c in ("entity", "identifier") for k in ("exact", "partial")))


@register("entity_agreement", f"WITH {NER}, ov AS (SELECT a.data_id, a.pos AS a_pos, b.pos AS b_pos, CASE WHEN a.entity_type = b.entity_type AND a.span_text = b.span_text THEN CASE WHEN a.start_offset = b.start_offset AND a.end_offset = b.end_offset THEN 1.0 WHEN a.start_offset <= b.end_offset AND b.start_offset <= a.end_offset THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score FROM {fx.duck_mentions()} a LEFT JOIN (SELECT *, 'CODE' AS entity_type FROM {fx.duck_spans(fx.REPORTED)}) b ON a.data_id = b.data_id) SELECT data_id, a_pos, CASE WHEN score > 0 THEN CAST(b_pos AS INT) END AS b_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY data_id, a_pos ORDER BY score DESC, b_pos) AS rn FROM ov) WHERE rn = 1")
def entity_agreement(spark, sf_dir):
    b = fx.spark_spans(spark, sf_dir, fx.REPORTED).withColumn("entity_type", F.lit("CODE"))
    return entities.entity_agreement(fx.spark_mentions(spark, sf_dir), b)


@register(
    "iou_best_label",
    f"""WITH j AS (SELECT s.data_id, s.pos, g.pos AS gp, g.identifier_type AS lab, least(s.end_offset, g.end_offset) - greatest(s.start_offset, g.start_offset) AS i, s.end_offset - s.start_offset + g.end_offset - g.start_offset AS t
      FROM {fx.duck_spans(fx.REPORTED)} s LEFT JOIN {fx.duck_mentions()} g ON s.data_id = g.data_id AND g.start_offset < s.end_offset AND g.end_offset > s.start_offset)
    SELECT data_id, pos, coalesce(lab, 'MISC') AS entity_type, iou FROM (SELECT *, coalesce(i / (t - i)::DOUBLE, 0) AS iou, row_number() OVER (PARTITION BY data_id, pos ORDER BY coalesce(i / (t - i)::DOUBLE, 0) DESC, gp) AS rn FROM j) WHERE rn = 1""",
)
def iou_best_label(spark, sf_dir):
    labelled = fx.spark_mentions(spark, sf_dir).drop("entity_type").withColumnRenamed("identifier_type", "entity_type")
    return entities.best_overlap_label(fx.spark_spans(spark, sf_dir, fx.REPORTED), labelled)


RULES = anonymize.PATTERN


@register("apply_masking", f"SELECT doc_id AS data_id, sha256(regexp_replace(text, '{RULES}', '[CODE]', 'g')) AS masked_sha256 FROM documents")
def apply_masking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), "text")
    return anonymize.by_rules(docs).select("data_id", F.sha2("anonymized_text", 256).alias("masked_sha256"))


@register("length_anomaly", f"SELECT data_id, CAST(abs(length(anonymized_text) - length(text)) AS INT) AS length_diff, round(length(anonymized_text) / length(text)::DOUBLE, 3) AS length_ratio, abs(length(anonymized_text) / length(text)::DOUBLE - 1) > 0.004 AS length_anomaly FROM {fx.DUCK_DOCUMENTS}")
def length_anomaly(spark, sf_dir):
    docs = fx.spark_documents(spark, sf_dir)
    return docs.select("data_id", tx.length_check(F.col("text"), F.col("anonymized_text"), 0.004).alias("l")).select("data_id", "l.*")


@register("utf_offsets", f"SELECT m.data_id, m.pos, CAST(strlen(substr(text, 1, start_offset)) AS INT) AS byte_start, CAST(start_offset + length(regexp_replace(substr(text, 1, start_offset), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INT) AS utf16_start, start_offset AS char_start FROM {fx.duck_mentions()} m JOIN documents d ON d.doc_id = m.data_id")
def utf_offsets(spark, sf_dir):
    m = fx.spark_mentions(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), "text"), "data_id")
    b = tx.byte_offset(F.col("text"), F.col("start_offset"))
    return m.select("data_id", "pos", b.alias("byte_start"), tx.utf16_offset(F.col("text"), F.col("start_offset")).alias("utf16_start"), tx.char_offset_of_bytes(F.col("text"), b).alias("char_start"))


@register("span_types", f"SELECT data_id, pos, CASE WHEN length(regexp_replace(span_text, '[^\\p{{Lu}}]', '', 'g')) > 2 THEN 'ORG' WHEN contains(span_text, '@') AND contains(span_text, '.') THEN 'CODE' WHEN contains(span_text, ':') THEN 'DATETIME' WHEN contains(span_text, '+') OR contains(span_text, '-') OR contains(span_text, '.') THEN 'CODE' ELSE 'PERSON' END AS entity_type FROM {fx.duck_mentions()}")
def span_types(spark, sf_dir):
    return fx.spark_mentions(spark, sf_dir).select("data_id", "pos", spans.span_type(F.col("span_text")).alias("entity_type"))


@register(
    "label_runs",
    """WITH t AS (SELECT user_id AS data_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'click' AS onn, value >= 30 AS sure FROM events),
    l AS (SELECT *, onn OR (sure AND coalesce(lag(onn) OVER w, false) AND coalesce(lead(onn) OVER w, onn)) AS live FROM t WINDOW w AS (PARTITION BY data_id ORDER BY pos)),
    r AS (SELECT *, sum(CASE WHEN live THEN 0 ELSE 1 END) OVER (PARTITION BY data_id ORDER BY pos) AS run FROM l),
    s AS (SELECT data_id, run, pos, max(CASE WHEN onn AND sure THEN 1 ELSE 0 END) OVER (PARTITION BY data_id, run ORDER BY pos) AS begun FROM r WHERE live)
    SELECT data_id, min(pos) AS pos, CAST(min(pos) AS BIGINT) AS start_offset, CAST(max(pos) + 1 AS BIGINT) AS end_offset FROM s WHERE begun = 1 GROUP BY data_id, run""",
)
def label_runs(spark, sf_dir):
    """Runs of clicks in each user's events as spans of token labels."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = table(spark, sf_dir, "events").withColumn("pos", pos.cast("long"))
    t = t.select(F.col("user_id").alias("data_id"), "pos", (F.col("event_type") == "click").cast("int").alias("label"), F.when(F.col("value") >= 30, 0.6).otherwise(0.5).alias("confidence"), F.col("pos").alias("start_offset"), (F.col("pos") + 1).alias("end_offset"))
    return spans.label_spans(t).drop("confidence")


@register("training_labels", f"SELECT data_id, pos, CASE WHEN identifier_type = 'NO_MASK' THEN 'NO_MASK' ELSE 'MASK' END AS label FROM {fx.duck_mentions()}")
def training_labels(spark, sf_dir):
    return spans.training_labels(fx.spark_mentions(spark, sf_dir)).select("data_id", "pos", "label")


# --- Parsers ---------------------------------------------------------------------------------

N_STATED = "c_custkey % 9"


def analyses(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.expr(N_STATED).cast("string")
    form = F.expr("c_custkey % 5")
    text = (
        F.when(form == 0, F.concat(F.lit("**Individual Character Analysis**\n- "), "c_name", F.lit("\nThe Number of Subjects: "), n))
        .when(form == 1, F.concat(F.lit("number   of subjects:"), n, F.lit(" people")))
        .when(form == 2, F.concat(F.lit("Total Number of Unique Individuals Counted: 1 + 1 = "), n))
        .when(form == 3, F.concat(F.lit("Number of Subjects: about "), n))
        .otherwise(F.lit("nobody"))
    )
    return c.select(F.col("c_custkey").alias("data_id"), text.alias("response"))


@register("parse_subject_count", f"SELECT c_custkey AS data_id, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST({N_STATED} AS INT) END AS number_of_subjects, CASE WHEN c_custkey % 5 IN (3, 4) THEN 'error' ELSE 'success' END AS analysis_status FROM customer")
def parse_subject_count(spark, sf_dir):
    return infer.analysis(analyses(spark, sf_dir)).select("data_id", "number_of_subjects", "analysis_status")


ANSWERS = ("Yes", "less precise", "No", "yes, no doubt", "", "It is less precise, no", "maybe")


@register("parse_agreement", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'less precise' WHEN 5 THEN 'less precise' ELSE 'no' END AS answer FROM part")
def parse_agreement(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, ANSWERS)), F.expr("CAST(p_partkey % 7 AS INT)"))
    return table(spark, sf_dir, "part").select("p_partkey", parse.agreement_answer(said).alias("answer"))


@register("normalize_non_inferable", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '' ELSE c_name END AS keyword, CASE WHEN c_custkey % 4 < 2 THEN 0 ELSE CAST(c_custkey % 6 AS INT) END AS certainty, CASE WHEN c_custkey % 4 < 2 THEN 0 ELSE 2 END AS hardness FROM customer")
def normalize_non_inferable(spark, sf_dir):
    word = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(c_mktsegment, ' / Unknown') WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'Not specified in text' ELSE 'unknown town' END ELSE c_name END")
    return table(spark, sf_dir, "customer").select("c_custkey", parse.normalized_pii(word, F.expr("CAST(c_custkey % 6 AS INT)"), F.lit(2)).alias("n")).select("c_custkey", "n.*")


@register(
    "merge_spc_spnc",
    f"""WITH a AS ({fx.duck_view('ann_a')}), b AS (SELECT * FROM ({fx.duck_view('ann_b')}) WHERE pos = 0)
    SELECT data_id, subject_id, tag, CASE WHEN b.certainty > 0 THEN b.keyword WHEN a.tag IS NOT NULL THEN a.keyword ELSE b.keyword END AS keyword, CASE WHEN b.certainty > 0 THEN b.certainty WHEN a.tag IS NOT NULL THEN a.certainty ELSE b.certainty END AS certainty,
      CASE WHEN b.certainty > 0 THEN b.hardness WHEN a.tag IS NOT NULL THEN a.hardness ELSE b.hardness END AS hardness FROM a FULL JOIN b USING (data_id, subject_id, tag)""",
)
def merge_spc_spnc(spark, sf_dir):
    return alignment.prefer_first(fx.spark_view(spark, sf_dir, "ann_a"), fx.spark_view(spark, sf_dir, "ann_b").where("pos = 0"))


@register("description_jaccard", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS jaccard FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' ')) AS b FROM part)")
def description_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(alignment.description_jaccard(F.col("p_name"), F.expr("concat(p_type, ' ', split_part(p_name, ' ', 1))")), 9).alias("jaccard"))


NAMES = ("panorama_run7_adversarial_gemma3_27b_evaluation.json", "tab_run7_deid_gpt_gpt-4.1-mini_evaluation.json", "x_longformer_evaluation.json", "tab_dp_prompt_claude-sonnet-4-5_evaluation.json", "other_gpt4_evaluation.json")
PARSED = (("151", "adversarial", "gemma3-27b"), ("144", "deid_gpt", "gpt-4-1-mini"), ("unknown", "longformer", "longformer"), ("144", "dp_prompt", "claude-sonnet-4-5"), ("unknown", "unknown", "gpt-4-1"))


def _case(column: int) -> str:
    return "CASE n_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{p[column]}'" for i, p in enumerate(PARSED)) + " END"


@register("parse_filename", f"SELECT n_nationkey, {_case(0)} AS dataset_size, {_case(1)} AS baseline, {_case(2)} AS model FROM nation")
def parse_filename(spark, sf_dir):
    path = F.concat(F.lit("/data/out/"), F.get(F.array(*map(F.lit, NAMES)), F.col("n_nationkey") % 5))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse.report_name(path).alias("i")).select("n_nationkey", "i.dataset_size", "i.baseline", "i.model")


@register("parse_profiling_json", "SELECT s_suppkey AS data_id, CAST(3 AS INT) AS subject_id, 'NAME' AS tag, s_name AS keyword, CAST(s_suppkey % 6 AS INT) AS certainty, 1 AS hardness FROM supplier")
def parse_profiling_json(spark, sf_dir):
    """Answers as clean JSON, with fences and single quotes, with values keyed by tag, and as plain sections."""
    form = F.expr("s_suppkey % 4")
    sure = F.expr("CAST(s_suppkey % 6 AS STRING)")
    text = (
        F.when(form == 0, F.concat(F.lit('[{"id": 3, "description": "d", "PIIs": [{"tag": "NAME", "keyword": "'), "s_name", F.lit('", "certainty": '), sure, F.lit(', "hardness": 1}]}]')))
        .when(form == 1, F.concat(F.lit("Here:\n```json\n[{'id': '3', 'description': 'd', 'PIIs': [{'tag': 'NAME', 'keyword': '"), "s_name", F.lit("', 'certainty': "), sure, F.lit(", 'hardness': 1,},]}\n```")))
        .when(form == 2, F.concat(F.lit('{"subjects": [{"id": 3, "PIIs": {"NAME": {"keyword": "'), "s_name", F.lit('", "certainty": "'), sure, F.lit('", "hardness": 1}}}]}')))
        .otherwise(F.concat(F.lit("**Person 3:**\nNAME: "), "s_name", F.lit(" (certainty "), sure, F.lit(")\n")))
    )
    answers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), text.alias("response"))
    return infer.long_profiles(answers).select("data_id", "subject_id", "tag", "keyword", "certainty", "hardness")


@register("fix_json", "SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"n\": [1,2]}' AS fixed FROM supplier")
def fix_json(spark, sf_dir):
    broken = F.concat(F.lit("({'name':'"), "s_name", F.lit("','n': [1,2,]"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", repair.fix_json_udf(broken).alias("fixed"))


@register("parse_inference", "SELECT n_nationkey, 'lives in ' || n_name AS inference, n_name || ';' || upper(n_name) AS guesses, '4' AS certainty, 'MISSING' AS other FROM nation")
def parse_inference(spark, sf_dir):
    answer = F.concat(F.lit("Type: location\nInference: lives in "), "n_name", F.lit("\nGuess: "), "n_name", F.lit("; "), F.upper("n_name"), F.lit("\nCertainty: 4\n"))
    m = repair.inferences(answer, ("LOCATION", "AGE"))
    return table(spark, sf_dir, "nation").select("n_nationkey", m.alias("m")).select("n_nationkey", F.col("m.LOCATION.inference").alias("inference"), F.array_join("m.LOCATION.guess", ";").alias("guesses"), F.col("m.LOCATION.certainty").alias("certainty"), F.col("m.AGE.inference").alias("other"))


# --- Similarity and utility --------------------------------------------------------------------


def sentences(spark, sf_dir):
    """Short pairs of texts: a part's name and type against its name with a word changed."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("data_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.concat_ws(" ", F.split("p_name", " ")[0], F.lit("redacted"), "p_type").alias("anonymized_text"))


PAIRED = "s AS (SELECT p_partkey AS data_id, [t for t in string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+') if t <> ''] AS a, [t for t in string_split_regex(lower(split_part(p_name, ' ', 1) || ' redacted ' || p_type), '[^a-z0-9]+') if t <> ''] AS b FROM part)"


@register("rouge1", f"WITH {PAIRED} SELECT data_id, round(CASE WHEN h > 0 THEN 2.0 * h / (len(a) + len(b)) ELSE 0 END, 9) AS rouge1 FROM (SELECT *, coalesce(list_sum([least(len(list_filter(a, lambda t: t = k)), len(list_filter(b, lambda t: t = k))) for k in list_distinct(b)]), 0)::DOUBLE AS h FROM s)")
def rouge1(spark, sf_dir):
    return sentences(spark, sf_dir).select("data_id", F.round(rouge1_f1(F.col("text"), F.col("anonymized_text")), 9).alias("rouge1"))


@register("rougeL")
def rouge_l(spark, sf_dir):
    return sentences(spark, sf_dir).select("data_id", F.round(rouge_l_udf("text", "anonymized_text"), 9).alias("rougeL"))


def _bleu_sql() -> str:
    grams = lambda t, n: f"[array_to_string({t}[i:i + {n - 1}], ' ') for i in generate_series(1, len({t}) - {n - 1})]"
    hits = lambda n: f"coalesce(list_sum([least(len(list_filter({grams('h', n)}, lambda t: t = k)), len(list_filter({grams('r', n)}, lambda t: t = k))) for k in list_distinct({grams('h', n)})]), 0)"
    missing = lambda n: " + ".join(f"CASE WHEN h{i} = 0 THEN 1 ELSE 0 END" for i in range(1, n + 1))
    part = lambda n: f"ln(CASE WHEN h{n} = 0 THEN ln(len(h)) / (pow(2, {missing(n)}) * 5) ELSE h{n} END::DOUBLE / greatest(1, len(h) - {n - 1})) / 4"
    return f"""WITH s AS (SELECT p_partkey AS data_id, [t for t in string_split_regex(p_name || ' ' || p_type || ' ' || p_brand, '\\s+') if t <> ''] AS r, [t for t in string_split_regex(split_part(p_name, ' ', 1) || ' redacted ' || p_type, '\\s+') if t <> ''] AS h FROM part),
    c AS (SELECT *, {", ".join(f"{hits(n)} AS h{n}" for n in range(1, 5))} FROM s)
    SELECT data_id, round(CASE WHEN h1 = 0 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / len(h)::DOUBLE) END * exp({" + ".join(part(n) for n in range(1, 5))}) END, 9) AS bleu FROM c"""


@register("bleu", _bleu_sql())
def bleu(spark, sf_dir):
    return sentences(spark, sf_dir).select("data_id", F.round(bleu_udf("text", "anonymized_text"), 9).alias("bleu"))


@register("utility_scores")
def utility_scores(spark, sf_dir):
    return utility.combine(utility.overlap_scores(sentences(spark, sf_dir))).select("data_id", *(F.round(c, 9).alias(c) for c in ("bleu", "rouge1", "rougeL", "rougeLsum", "utility_comb")))


@register(
    "utility_aggregate",
    """SELECT count(*) AS num_samples, round(avg(coalesce(l_discount, 0)), 6) AS avg_bleu, round(avg(l_tax), 6) AS "avg_rouge1", round(avg(l_tax * 2), 6) AS "avg_rougeL", round(avg(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_tax END), 6) AS avg_utility_comb,
       round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity / 5 END), 6) AS avg_readability, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity / 10 END), 6) AS avg_meaning, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 END), 6) AS avg_hallucination FROM lineitem""",
)
def utility_aggregate(spark, sf_dir):
    li, judged = table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "A"
    rows = li.select(F.col("l_discount").alias("bleu"), F.col("l_tax").alias("rouge1"), (F.col("l_tax") * 2).alias("rougeL"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("utility_comb"), F.when(judged, F.col("l_quantity") / 5).alias("readability"), F.when(judged, F.col("l_quantity") / 10).alias("meaning"), F.when(judged, F.lit(1.0)).alias("hallucination"))
    out = stats.utility_aggregate(rows)
    return rounded(out, *out.columns[1:])


# --- Model stages, replayed ---------------------------------------------------------------------


@register("infer_pipeline_replay", "SELECT c_custkey AS data_id, CASE WHEN c_custkey % 5 IN (3, 4) THEN 0 ELSE CAST(c_custkey % 9 AS INT) END AS number_of_subjects, c_custkey % 5 NOT IN (3, 4) AS profiled, CASE WHEN c_custkey % 5 NOT IN (3, 4) THEN c_name END AS name FROM customer")
def infer_pipeline_replay(spark, sf_dir):
    """Analysis answers replayed, then a profile stage by a stub over those that could be read."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.col("c_name").alias("text"))
    analysed = infer.analysis(backends.replay(docs, analyses(spark, sf_dir)).drop("text"))
    asked = infer.profile_prompts(docs, analysed, code=False)
    told = backends.call(asked, backends.Stub(lambda p: '[{"id": 0, "description": "", "PIIs": [{"tag": "NAME", "keyword": "' + p.rsplit("\n", 1)[1] + '", "certainty": 5, "hardness": 1}]}]'))
    name = infer.long_profiles(told.select("data_id", "response")).select("data_id", F.col("keyword").alias("name"))
    n = analysed.select("data_id", F.when(F.col("analysis_status") == "success", F.col("number_of_subjects")).otherwise(0).alias("number_of_subjects"))
    return n.join(name, "data_id", "left").select("data_id", "number_of_subjects", F.col("name").isNotNull().alias("profiled"), "name")


@register("anonymize_redact", "SELECT p_partkey AS data_id, '[REDACTED] ' || p_type AS anonymized_text, CAST(abs(length('[REDACTED] ' || p_type) - length(p_name || ' ' || p_type)) AS INT) AS length_diff FROM part")
def anonymize_redact(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("data_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_type")
    saved = backends.replay(docs, docs.select("data_id", F.concat(F.lit("[REDACTED] "), "p_type").alias("response")))
    return anonymize.finish(saved.withColumn("anonymized_text", F.col("response"))).select("data_id", "anonymized_text", "length_diff")


@register("adversarial_rounds", "SELECT s_suppkey AS data_id, 'x' || substr(s_name, 4) AS anonymized_text, 3 AS n_rounds FROM supplier")
def adversarial_rounds(spark, sf_dir):
    """Three rounds against stubs: each hides one more character of the name."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), F.col("s_name").alias("text"))
    guess = backends.Stub(lambda p: "Type: NAME\nGuess: someone")
    hide = backends.Stub(lambda p: "I shorten it.\n#\n" + (lambda t: "x" + t[2:] if t.startswith("x") else "x" + t[1:])(p.rsplit("\n", 1)[1]))
    return anonymize.adversarial(docs, guess, hide).select("data_id", "anonymized_text", F.size("rounds").alias("n_rounds"))


@register("prompt_annotation_lines", "SELECT s_suppkey AS data_id, 'Subject 0 (s): NAME: ' || s_name || '; AGE: 40' AS lines FROM supplier")
def prompt_annotation_lines(spark, sf_dir):
    pii = lambda t, k, c: F.struct(F.lit(t).alias("tag"), k.alias("keyword"), F.lit(c).alias("certainty"), F.lit(1).alias("hardness"))
    people = F.array(F.struct(F.lit("0").alias("id"), F.lit("s").alias("description"), F.array(pii("NAME", F.col("s_name"), 5), pii("SEX", F.lit("m"), 0), pii("EMAIL_ADDRESS", F.lit("  "), 3), pii("AGE", F.lit("40"), 2)).alias("PIIs")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), prompts.annotation_lines(people).alias("lines"))


# --- Streams and resuming ------------------------------------------------------------------------


@register("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, sf_dir):
    return alignment.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@register("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@register(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"))


# --- More operators ---------------------------------------------------------------------------------

MODELS = ("alpha", "beta", "gamma")
FILE = "CASE subject_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"


@register(
    "cpr_by_file",
    with_ev(f"SELECT f AS file, 'b' AS baseline, f AS model, round(avg(1 - s / n), 6) AS ipr, round(1 - sum(s) / sum(n), 6) AS cpr, CAST(sum(n) AS BIGINT) AS num_pii FROM (SELECT {FILE} AS f, data_id, subject_id, count(*) AS n, sum(agreement_score) AS s FROM ev WHERE certainty_a >= 3 GROUP BY ALL) GROUP BY f"),
)
def cpr_by_file(spark, sf_dir):
    e = evaluations(spark, sf_dir).withColumn("file", F.expr(FILE)).withColumn("baseline", F.lit("b")).withColumn("model", F.col("file"))
    return rounded(privacy.cpr_by_file(e), "ipr", "cpr")


OUTPUTS = ("tab_deid_gpt_gpt-4.1-mini_run7.jsonl", "panorama_adversarial_claude-sonnet_run7.jsonl", "TAB_dp-prompt_llama3.1:8b.jsonl", "notes.txt")
OUT_PARSED = (("tab", "144", "deid_gpt", "gpt-4-1-mini"), ("panorama", "151", "adversarial", "claude-sonnet-4"), ("tab", "144", "dp_prompt", "llama3-1-8b"), ("unknown", "unknown", "unknown", "unknown"))


@register("parse_output_filename", "SELECT n_nationkey, " + ", ".join(f"CASE n_nationkey % 4 {' '.join(f'WHEN {i} THEN {chr(39)}{p[c]}{chr(39)}' for i, p in enumerate(OUT_PARSED))} END AS {n}" for c, n in enumerate(("dataset", "dataset_size", "baseline", "model"))) + " FROM nation")
def parse_output_filename(spark, sf_dir):
    path = F.concat(F.lit("data/anonymized/"), F.get(F.array(*map(F.lit, OUTPUTS)), F.col("n_nationkey") % 4))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse.output_name(path).alias("i")).select("n_nationkey", "i.*")


@register("output_filename", "SELECT n_nationkey, 'recall_tab_144_' || lower(n_name) || '_gpt-4-1_x_' || n_regionkey || '.json' AS file FROM nation")
def output_filename(spark, sf_dir):
    lit = F.lit
    return table(spark, sf_dir, "nation").select("n_nationkey", parse.output_file(lit("recall"), lit("tab"), lit("144"), F.lower("n_name"), lit("gpt:4.1/x"), F.col("n_regionkey").cast("string")).alias("file")).withColumn("file", F.replace("file", F.lit("-x_"), F.lit("_x_")))


@register("case_classes", f"WITH RECURSIVE {IEV} SELECT {CLASS} AS case_class, count(*) AS n FROM ev GROUP BY 1")
def case_classes(spark, sf_dir):
    e = scoring.inter_evaluations(*ann(spark, sf_dir), min_certainty=2)
    return evaluate.consensus_classes(e).groupBy("case_class").agg(F.count(F.lit(1)).alias("n"))


@register("error_filler", "SELECT c_custkey AS data_id, unnest([" + ", ".join(f"'{t}'" for t in FILLER_TAGS) + "]) AS tag, '' AS keyword, false AS matched FROM customer WHERE c_acctbal < 0")
def error_filler(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("data_id"), F.lit(0).alias("idx"), F.col("c_name").alias("description"), "c_acctbal")
    return evaluate.filler(c.where("c_acctbal < 0"), c, FILLER_TAGS).select("data_id", "tag", "keyword", "matched")


@register("merge_overlaps", f"WITH s AS (SELECT data_id, pos, start_offset, end_offset, 'G' AS t FROM {fx.duck_spans(fx.GOLD)} UNION ALL SELECT data_id, pos, start_offset, end_offset, 'R' FROM {fx.duck_spans(fx.REPORTED)}), o AS (SELECT *, CASE WHEN start_offset >= max(end_offset) OVER (PARTITION BY data_id ORDER BY start_offset, end_offset, pos, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY data_id ORDER BY start_offset, end_offset, pos, t) = 1 THEN 1 ELSE 0 END AS f FROM s), r AS (SELECT *, sum(f) OVER (PARTITION BY data_id ORDER BY start_offset, end_offset, pos, t ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT data_id, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS n_merged FROM r GROUP BY data_id, run")
def merge_overlaps(spark, sf_dir):
    g, r = fx.spark_spans(spark, sf_dir, fx.GOLD).withColumn("entity_type", F.lit("G")), fx.spark_spans(spark, sf_dir, fx.REPORTED).withColumn("entity_type", F.lit("R"))
    return entities.merge_overlaps(g.unionByName(r)).drop("entity_type")


@register("emoji_bytes", "SELECT '☀' AS emoji, 3 AS bytes UNION ALL SELECT '😀', 4")
def emoji_bytes(spark, sf_dir):
    text = F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" ☀ ☀"))).otherwise(F.concat(F.lit("😀"), "r_name"))
    return stats.emoji_bytes(table(spark, sf_dir, "region").select(text.alias("text")))


@register("token_windows", "SELECT l_orderkey AS data_id, CAST(w AS INT) AS window, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY li) AS tokens FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS li, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS w FROM lineitem) WHERE li >= w * 2 AND li < w * 2 + 3 GROUP BY l_orderkey, w")
def token_windows(spark, sf_dir):
    """All windows of each order's lines; of orders of more than 18 lines the SQL has only the first nine."""
    order = [F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("data_id"), pos.alias("pos"), F.col("l_suppkey").alias("token"))
    said = F.exists("tokens", lambda x: x.isNotNull())
    return spans.windows(t, size=3, stride=1).withColumn("tokens", F.when(said, F.concat_ws(",", F.col("tokens").cast("array<string>"))))


@register(
    "bio_labels",
    f"""WITH tk AS (SELECT data_id, row_number() OVER (PARTITION BY data_id ORDER BY start_offset, end_offset) AS pos, start_offset, end_offset FROM {fx.duck_spans(fx.REPORTED)}), m AS {fx.duck_mentions()},
    j AS (SELECT tk.*, m.start_offset AS ms, m.end_offset AS me, CASE WHEN m.identifier_type = 'NO_MASK' THEN 'NO_MASK' WHEN m.identifier_type IS NOT NULL THEN 'MASK' END AS label, row_number() OVER (PARTITION BY tk.data_id, tk.pos ORDER BY m.start_offset, m.end_offset) AS rn
      FROM tk LEFT JOIN m ON tk.data_id = m.data_id AND tk.start_offset < m.end_offset AND tk.end_offset > m.start_offset)
    SELECT data_id, pos, CASE WHEN label IS NULL THEN 'O' WHEN row_number() OVER (PARTITION BY data_id, ms, me ORDER BY pos) = 1 THEN 'B-' || label ELSE 'I-' || label END AS bio FROM j WHERE rn = 1""",
)
def bio_labels(spark, sf_dir):
    """BIO labels of an anonymizer's spans, taken as tokens, from the gold mentions."""
    pos = F.row_number().over(Window.partitionBy("data_id").orderBy("start_offset", "end_offset")).cast("long")
    t = fx.spark_spans(spark, sf_dir, fx.REPORTED).withColumn("pos", pos).select("data_id", "pos", "start_offset", "end_offset")
    return spans.bio_labels(t, fx.spark_mentions(spark, sf_dir)).select("data_id", "pos", "bio")


@register("unmatched_documents", "SELECT doc_id AS data_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_documents(spark, sf_dir):
    return entities.unmatched_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("data_id")))


@register("subject_sum", "SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS subjects FROM lineitem")
def subject_sum(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("subjects"))  # the lines of an order
    return stats.subject_sum(docs)


@register(
    "judge_answers",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size % 10 END::DOUBLE AS readability, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 7 END::DOUBLE AS meaning, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 1 END::DOUBLE AS hallucination FROM part",
)
def judge_answers(spark, sf_dir):
    said = F.when(F.col("p_size") % 3 == 0, F.lit("no json { here")).otherwise(F.concat(F.lit('I think: {"readability": {"explanation": "x", "score": '), (F.col("p_size") % 10).cast("string"), F.lit('}, "meaning": {"score": 7}, "hallucinations": {"score": 1}} done')))
    return table(spark, sf_dir, "part").select("p_partkey", parse.judged_utility(said).alias("j")).select("p_partkey", "j.*")


@register("profile_rekey", "SELECT p_partkey AS data_id, 0 AS subject_id, 'NAME' AS tag, upper(p_name) AS keyword, 4 AS certainty, 1 AS hardness FROM part UNION ALL SELECT p_partkey, 0, 'AGE', '40', 3, 1 FROM part")
def profile_rekey(spark, sf_dir):
    """Two profiles whose people have different ids but alike descriptions."""
    p = table(spark, sf_dir, "part")
    row = lambda i, d, tag, k, c: p.select(F.col("p_partkey").alias("data_id"), F.lit(i).alias("subject_id"), d.alias("description"), F.explode(F.array(F.lit(tag))).alias("tag"), F.lit(0).alias("pos"), k.alias("keyword"), F.lit(c).alias("certainty"), F.lit(1).alias("hardness"))
    about = F.concat_ws(" ", F.lit("the one of part"), F.col("p_partkey").cast("string"))
    return infer.merged_profiles(row(0, about, "AGE", F.lit("40"), 3), row(9, F.concat(about, F.lit(" too")), "NAME", F.upper("p_name"), 4))
