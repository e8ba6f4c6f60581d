"""Agreement, alignment, entity and utility statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = F.count


def _rate(part, whole):
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def _agreement():
    n, m, p, x = N(F.lit(1)), N(F.when(F.col("match"), 1)), N(F.when(F.col("less_precise"), 1)), N(F.when(~F.col("match") & ~F.col("less_precise"), 1))
    return [
        n.alias("total_comparisons"), m.alias("total_matches"), p.alias("total_less_precise"), x.alias("total_mismatches"),
        _rate(m, n).alias("match_rate"), _rate(p, n).alias("less_precise_rate"), _rate(x, n).alias("mismatch_rate"), F.coalesce(F.avg("agreement_score"), F.lit(0.0)).alias("average_score"),
    ]


def agreement_stats(evaluations: DataFrame, k: int = 0) -> DataFrame:
    return evaluations.where(F.col("certainty_a") >= k).agg(*_agreement())


def agreement_by_tag(evaluations: DataFrame, k: int = 0) -> DataFrame:
    return evaluations.where(F.col("certainty_a") >= k).groupBy("tag").agg(*_agreement())


def certainty_buckets(evaluations: DataFrame, highest: int = 5) -> DataFrame:
    """The statistics for every least certainty 0..highest, in one pass over the rows.

    Rows are first summed by their own certainty; a bucket adds up at most
    ``highest + 1`` such sums.
    """
    own = evaluations.groupBy("certainty_a").agg(
        N(F.lit(1)).alias("n"), N(F.when(F.col("match"), 1)).alias("m"), N(F.when(F.col("less_precise"), 1)).alias("p"), F.sum("agreement_score").alias("s")
    )
    least = F.explode(F.sequence(F.lit(0), F.least(F.col("certainty_a"), F.lit(highest)))).alias("min_certainty")
    spread = own.where("certainty_a >= 0").select(least, "n", "m", "p", "s")
    return spread.groupBy("min_certainty").agg(
        F.sum("n").alias("total_comparisons"), F.sum("m").alias("total_matches"), F.sum("p").alias("total_less_precise"),
        (F.sum("n") - F.sum("m") - F.sum("p")).alias("total_mismatches"), (F.sum("s") / F.sum("n")).alias("average_score"),
    )


def tags_by_score(evaluations: DataFrame, top: int) -> DataFrame:
    return agreement_by_tag(evaluations).select("tag", "average_score", "total_comparisons").orderBy(F.desc("average_score"), "tag").limit(top)


def case_logs(evaluations: DataFrame, mode: str = "all") -> DataFrame:
    """One formatted line per case with its group; ``mode`` is all, disagree or mismatch (others mean all)."""
    group = F.when(F.col("agreement_score") == 0, "0.0").when(F.col("agreement_score") == 0.5, "0.5").when(F.col("keyword_a") != F.col("keyword_b"), "1.0-differs").otherwise("1.0")
    line = F.concat(
        F.lit("["), F.col("data_id").cast("string"), F.lit("]["), F.col("subject_id").cast("string"), F.lit("] ["), "evaluation_method", F.lit("] ["), "tag", F.lit("] '"),
        "keyword_a", F.lit("' vs '"), "keyword_b", F.lit("' | score="), F.col("agreement_score").cast("string"),
    )
    wanted = {"disagree": F.col("agreement_score") < 1, "mismatch": F.col("agreement_score") == 0}.get(mode, F.lit(True))
    return evaluations.where(wanted).select("data_id", "subject_id", group.alias("case_group"), line.alias("log"))


def subject_stats(aligned: DataFrame) -> DataFrame:
    """Per-document counts of aligned subjects: data_id, matched (null counts as true), unmatched_side."""
    matched = F.coalesce("matched", F.lit(True))
    a, b = ~matched & (F.col("unmatched_side") == "A"), ~matched & (F.col("unmatched_side") == "B")
    return aligned.groupBy("data_id").agg(
        N(F.when(matched | a, 1)).alias("subjects_a"), N(F.when(matched | b, 1)).alias("subjects_b"), N(F.when(matched, 1)).alias("matched"),
        N(F.when(a, 1)).alias("unmatched_a"), N(F.when(b, 1)).alias("unmatched_b"),
    )


def subject_totals(aligned: DataFrame) -> DataFrame:
    t = subject_stats(aligned).agg(
        N(F.lit(1)).alias("total_documents"), F.sum("subjects_a").alias("total_subjects_a"), F.sum("subjects_b").alias("total_subjects_b"),
        F.sum("matched").alias("matched_subjects"), F.sum("unmatched_a").alias("unmatched_a"), F.sum("unmatched_b").alias("unmatched_b"),
        N(F.when(F.col("subjects_a") != F.col("subjects_b"), 1)).alias("docs_with_subject_mismatch"),
    )
    every = F.col("matched_subjects") + F.col("unmatched_a") + F.col("unmatched_b")
    return t.withColumn("total_unique_subjects", every).withColumn("subject_match_rate", _rate(F.col("matched_subjects"), every))


def alignment_summary(aligned: DataFrame, piis: DataFrame) -> DataFrame:
    """Summary of a ground-truth-anchored alignment.

    ``aligned``: data_id, subject_id, matched; ``piis``: data_id, subject_id,
    keyword of the ground truth's values.
    """
    filled = piis.where("trim(keyword) <> ''").groupBy("data_id", "subject_id").agg(N(F.lit(1)).alias("n"))
    per = aligned.join(filled, ["data_id", "subject_id"], "left").groupBy("data_id").agg(
        N(F.lit(1)).alias("subjects"), N(F.when(F.col("matched"), 1)).alias("hit"), F.coalesce(F.sum(F.when(~F.col("matched"), F.col("n"))), F.lit(0)).alias("lost")
    )
    s, h = F.sum("subjects"), F.sum("hit")
    return per.agg(
        s.alias("gt_subjects"), h.alias("matched_subjects"), (s - h).alias("gt_only_subjects"), F.sum("lost").alias("gt_only_piis"), _rate(h, s).alias("match_ratio"),
        _rate(s - h, s).alias("gt_miss_ratio"), F.avg("hit").alias("avg_matched_per_doc"), N(F.when(F.col("subjects") > F.col("hit"), 1)).alias("docs_with_gt_only"),
    )


def _filled(keyword):
    return F.coalesce(keyword.rlike(r"(?U)\S"), F.lit(False))


def match_stats(a: DataFrame, b: DataFrame, pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Per document, what an alignment matched and what either side has alone.

    ``a`` (ground truth) and ``b`` (model): data_id, idx, id; ``pairs``: data_id, a_idx, b_idx;
    ``values``: data_id, side (A or B), idx, keyword.  Ids without a partner come in order of idx,
    a null id as its idx.  Everything is counted by subject before it is put together by document.
    """
    none, no = F.lit(None).cast("string"), F.lit(0)
    subject = lambda d, side: d.select("data_id", F.lit(side).alias("side"), "idx", F.coalesce(F.col("id").cast("string"), F.col("idx").cast("string")).alias("id"), no.alias("hit"), no.alias("filled"))
    partner = lambda side, idx: pairs.select("data_id", F.lit(side).alias("side"), F.col(idx).alias("idx"), none.alias("id"), F.lit(1).alias("hit"), no.alias("filled"))
    value = values.select("data_id", "side", "idx", none.alias("id"), no.alias("hit"), _filled(F.col("keyword")).cast("int").alias("filled"))
    rows = subject(a, "A").unionByName(subject(b, "B")).unionByName(partner("A", "a_idx")).unionByName(partner("B", "b_idx")).unionByName(value)
    own = rows.groupBy("data_id", "side", "idx").agg(F.max("id").alias("id"), (F.max("hit") == 1).alias("hit"), F.sum("filled").alias("filled")).where("id is not null")
    on_a, alone = F.col("side") == "A", ~F.col("hit")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("idx", "id")))), lambda x: x["id"])
    return own.groupBy("data_id").agg(
        N(F.when(on_a, 1)).alias("gt_subjects"), N(F.when(~on_a, 1)).alias("llm_subjects"), N(F.when(on_a & F.col("hit"), 1)).alias("matched"),
        F.coalesce(F.sum(F.when(on_a & alone, F.col("filled"))), F.lit(0)).alias("gt_only_piis"), F.coalesce(F.sum(F.when(~on_a & alone, F.col("filled"))), F.lit(0)).alias("llm_only_piis"),
        ids(on_a & alone).alias("gt_only_ids"), ids(~on_a & alone).alias("llm_only_ids"),
    )


def saved_match_stats(documents: DataFrame) -> DataFrame:
    """The counts of ``match_stats`` from saved alignments (``schemas.ALIGNED_DOC``), without a shuffle.

    Documents in error or without subjects are left out.  A subject saved without ``matched`` counts as
    matched if the other annotation has any value that isn't blank.  Subjects of the model alone aren't saved.
    """
    n_filled = lambda piis: F.size(F.filter(F.coalesce(piis, F.array().cast("array<struct<tag:string,keyword:string,certainty:int,hardness:int>>")), lambda p: _filled(p["keyword"])))
    subjects = F.transform(
        "subjects",
        lambda s, i: F.struct(
            F.coalesce(s["matched"], n_filled(s["PIIs"]["annotation_B"]) > 0).alias("hit"), n_filled(s["PIIs"]["annotation_A"]).alias("filled"), F.coalesce(s["id"].cast("string"), i.cast("string")).alias("id")
        ),
    )
    live = documents.where("coalesce(status, '') <> 'error' and size(subjects) > 0").select("metadata.data_id", subjects.alias("s"))
    alone = live.withColumn("alone", F.filter("s", lambda x: ~x["hit"]))
    hits, zero = (F.size("s") - F.size("alone")).cast("long"), F.lit(0).cast("long")
    return alone.select(
        "data_id", F.size("s").cast("long").alias("gt_subjects"), hits.alias("llm_subjects"), hits.alias("matched"), F.aggregate("alone", zero, lambda n, x: n + x["filled"]).alias("gt_only_piis"),
        zero.alias("llm_only_piis"), F.transform("alone", lambda x: x["id"]).alias("gt_only_ids"), F.array().cast("array<string>").alias("llm_only_ids"),
    )


def run_sums(per_document: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The sums of ``run_totals``: rows of several parts of the documents add up to that of all."""
    rows = per_document.withColumn("ok", F.lit(True))
    if failed is not None:
        rows = rows.unionByName(failed.withColumn("ok", F.lit(False)))
    ok, lone = F.col("ok"), F.size("gt_only_ids")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        N(F.when(ok, 1)).alias("documents"), total(F.when(ok, F.col("gt_subjects") + F.col("llm_subjects"))).alias("subjects_of_both"),
        total(F.when(ok, F.col("matched") + lone + F.size("llm_only_ids"))).alias("distinct_subjects"), total(F.col("matched") + lone).alias("gt_subjects"), total("matched").alias("matched_subjects"),
        total(lone).alias("gt_only_subjects"), total("gt_only_piis").alias("gt_only_piis"), total(F.size("llm_only_ids")).alias("llm_only_subjects"), total("llm_only_piis").alias("llm_only_piis"),
        N(F.when(lone > 0, 1)).alias("docs_with_gt_only"),
    )


def with_rates(sums: DataFrame) -> DataFrame:
    m, g = F.col("matched_subjects"), F.col("gt_subjects")
    return sums.withColumn("match_ratio", F.round(_rate(m, g), 4)).withColumn("gt_miss_ratio", F.round(_rate(F.col("gt_only_subjects"), g), 4)).withColumn("avg_matched_per_doc", F.round(_rate(m, F.col("documents")), 2))


def run_totals(per_document: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row over the counts of all documents, new and saved ones alike (``unionByName`` of both).

    Documents in ``failed`` (of the same columns) count with all their subjects as the ground truth's alone,
    but neither as processed nor among the distinct subjects.
    """
    return with_rates(run_sums(per_document, failed))


def ner_stats(matches: DataFrame) -> DataFrame:
    """Exact, partial (exact ones included) and missing agreement of entity and identifier types."""
    n = N(F.lit(1))
    out = [n.alias("total_entities")]
    for name in ("entity_type", "identifier_type"):
        score = F.col(f"{name}_score")
        exact, part = N(F.when(score == 1, 1)), N(F.when(score > 0, 1))
        out += [exact.alias(f"{name}_exact"), part.alias(f"{name}_partial"), (n - part).alias(f"{name}_mismatch"), _rate(exact, n).alias(f"{name}_exact_rate"), _rate(part, n).alias(f"{name}_partial_rate")]
    return matches.agg(*out)


def utility_aggregate(scores: DataFrame) -> DataFrame:
    """Means: overlap scores over all rows (missing is 0), judged ones over the rows that have them."""
    every = [F.avg(F.coalesce(c, F.lit(0.0))).alias(f"avg_{c}") for c in ("bleu", "rouge1", "rougeL", "utility_comb")]
    some = [F.avg(c).alias(f"avg_{c}") for c in ("readability", "meaning", "hallucination")]
    return scores.agg(N(F.lit(1)).alias("num_samples"), *every, *some)


def run_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(N(F.lit(1)).alias("documents"))


def emoji_bytes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct emoji of a text column and their UTF-8 sizes."""
    from veilframe.functions.text import EMOJI

    found = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(EMOJI), F.lit(0))).alias("emoji"))
    return found.distinct().withColumn("bytes", F.octet_length("emoji"))


def subject_sum(documents: DataFrame, subjects: str = "subjects") -> DataFrame:
    """Documents and the sum of their subjects."""
    return documents.agg(N(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.greatest(F.size(subjects), F.lit(0))), F.lit(0)).alias("subjects"))
