"""The two evaluation pipelines: against ground truth, and between annotators."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import prompts
from veilframe.backends import Backend
from veilframe.functions.parse import agreement_answer, alignment_pairs
from veilframe.operators import alignment, privacy, scoring, stats
from veilframe.sources.folders import work_folder, written
from veilframe.sources.ledger import Ledger


def combine(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Documents of both collections by id (the last of equal ids), with both annotations."""
    a, b = (alignment.keep_last(d, "data_id", "ordinal") for d in (gold, found))
    return a.select("data_id", "text", F.col("subjects").alias("annotation_A")).join(b.select("data_id", F.col("subjects").alias("annotation_B")), "data_id")


def align_prompts(combined: DataFrame) -> DataFrame:
    """Documents that can be aligned, with their prompt; the others are errors()."""
    return combined.where("size(annotation_A) > 0 and size(annotation_B) > 0").withColumn("prompt", prompts.align(F.col("text"), F.col("annotation_A"), F.col("annotation_B")))


def align_errors(combined: DataFrame) -> DataFrame:
    return combined.where("coalesce(size(annotation_A), 0) <= 0 or coalesce(size(annotation_B), 0) <= 0").select("data_id", F.lit("missing annotations").alias("error"))


def matched_pairs(answers: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Valid pairs of subjects from the aligner's answers (data_id, response)."""
    pairs = answers.select("data_id", F.explode(alignment_pairs(F.col("response"))).alias("p")).select("data_id", "p.*")
    return alignment.valid_pairs(pairs, a, b)


def filler(documents: DataFrame, subjects: DataFrame, tags) -> DataFrame:
    """For documents whose alignment failed: every subject of the ground truth, unmatched, with blank values."""
    rows = subjects.join(documents.select("data_id"), "data_id")
    return rows.select("data_id", F.col("idx").alias("subject_id"), "description", F.lit("error").alias("status"), F.lit(False).alias("matched"), F.explode(F.array(*map(F.lit, tags))).alias("tag")).withColumn("keyword", F.lit("")).withColumn("certainty", F.lit(0)).withColumn("hardness", F.lit(0))


def run_alignment(combined: DataFrame, answers: DataFrame, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """One run of the aligner: checks answers, numbers subjects, gives failures a type and counts.

    ``combined``: data_id, text, annotation_A, annotation_B (arrays of ``schemas.SUBJECT``); ``answers``:
    data_id, status, response to ``align_prompts`` (``backends.call``, ``cached_call`` or ``replay``), kept as
    a table, as it is read several times; ``done``: data_ids that an earlier run has, left out.
    Returns aligned (a row per subject), errors (data_id, error_type, error), per_document
    (``stats.match_stats``) and totals, in which failed documents count as the ground truth's alone.
    """
    todo = combined if done is None else alignment.resume(combined, done, "data_id")
    side = lambda c: todo.select("data_id", F.posexplode(c).alias("idx", "s")).select("data_id", "idx", "s.*")
    a, b = side("annotation_A"), side("annotation_B")
    told = align_prompts(todo).select("data_id").join(answers.select("data_id", "status", "response"), "data_id", "left")
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    ok, unread = told.where(good), told.where(~good).select("data_id", F.lit("alignment").alias("error_type"), F.coalesce("response", F.lit("no answer")).alias("error"))
    lost = align_errors(todo).select("data_id", F.lit("missing_annotations").alias("error_type"), "error").unionByName(unread)
    pairs = matched_pairs(ok, a, b)
    value = lambda d, s: d.select("data_id", F.lit(s).alias("side"), "idx", F.explode("PIIs").alias("p")).select("data_id", "side", "idx", "p.keyword")
    of = lambda d, ids: d.join(ids.select("data_id"), "data_id", "left_semi")
    per = stats.match_stats(of(a, ok), of(b, ok), pairs, of(value(a, "A").unionByName(value(b, "B")), ok))
    failed = stats.match_stats(of(a, lost), b.where("false"), pairs.where("false"), of(value(a, "A"), lost))
    return {"aligned": alignment.align_gt(of(a, ok), of(b, ok), pairs), "errors": lost, "per_document": per, "totals": stats.run_totals(per, failed)}


def align_documents(combined: DataFrame, backend, ledger: Ledger | None = None, done: DataFrame | None = None, attempts: int = 3) -> dict[str, DataFrame]:
    """The aligner as one run: asks, keeps the answers, asks failed calls and unreadable answers' documents again, reports.

    A document gets up to ``attempts`` passes; one whose last answer states no
    section at all is asked again like one whose call failed.  A run that is
    started again with the same ``ledger`` asks only what it lacks.  Returns what
    ``run_alignment`` does, and passes (data_id, attempt, status).
    """
    ledger = ledger or Ledger(combined.sparkSession)
    todo = combined if done is None else alignment.resume(combined, done, "data_id")
    asked = align_prompts(todo).select("data_id", "prompt")
    strict = Stated(backend)
    answers = ledger.ask(asked, strict, "align", attempts=attempts)
    answers = written(answers.drop("prompt"), work_folder(combined.sparkSession), "answers")
    tries = ledger.answers("align").select("key", "attempt", "status")
    passes = asked.select("data_id", F.sha2(F.concat(F.lit("\n"), F.col("prompt")), 256).alias("key")).join(tries, "key").select("data_id", "attempt", "status")
    return {**run_alignment(todo, answers), "passes": passes}


@dataclass(frozen=True)
class Stated:
    """A backend whose answers state a result; others are failed calls."""

    backend: Backend

    def __call__(self, prompt: str) -> str:
        answer = self.backend(prompt)
        if not re.search(r"result:\s*(un)?matched", answer or "", re.I):
            raise ValueError(f"no result in answer: {answer}")
        return answer


def evaluate_ground_truth(a: DataFrame, b: DataFrame, k: int = 3, max_depth: int | None = None, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Evaluations of aligned annotations and everything that is reported from them."""
    e = scoring.gt_evaluations(a, b, max_depth=max_depth, decisions=decisions)
    return {"evaluations": e, "statistics": stats.agreement_stats(e), "by_tag": stats.agreement_by_tag(e), "by_certainty": stats.certainty_buckets(e), "cases": stats.case_logs(e), "privacy": privacy.ipr_cpr(e, k), "privacy_by_tag": privacy.cpr_by_tag(e, k)}


def evaluate_annotators(a: DataFrame, b: DataFrame, aligned: DataFrame, min_certainty: int = 0, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    e = scoring.inter_evaluations(a, b, min_certainty, decisions=decisions)
    return {"evaluations": e, "statistics": stats.agreement_stats(e), "subjects": stats.subject_totals(aligned), "classes": consensus_classes(e), "agreed": consensus(a, e)}


def model_decisions(answers: DataFrame) -> DataFrame:
    """Decisions from a model's answers to ``scoring.questions`` (keyword_a, keyword_b, tag, response)."""
    return answers.select("keyword_a", "keyword_b", "tag", agreement_answer(F.col("response")).alias("answer"), F.lit("MODEL").alias("method"))


def decide(scored: DataFrame, backend, truth: bool = True, ledger: Ledger | None = None, attempts: int = 1) -> DataFrame:
    """A model's decisions on the pairs that rules score 0, each distinct pair asked once through ``ledger``.

    ``truth``: whether the first value is the truth or another annotator's.  A
    failed call is a decision without an answer, which keeps the score of 0.
    """
    asked = scoring.questions(scored)
    prompt = prompts.agree(F.coalesce("keyword_a", F.lit("")), F.coalesce("keyword_b", F.lit("")), F.col("tag"), truth)
    told = (ledger or Ledger(scored.sparkSession)).ask(asked.withColumn("prompt", prompt), backend, "agree-truth" if truth else "agree-annotators", attempts=attempts)
    said = model_decisions(told.withColumn("response", F.when(F.col("status") == "success", F.col("response"))))
    return said.withColumn("answer", F.when(F.col("method").isNotNull(), F.col("answer")))


def consensus_classes(evaluations: DataFrame) -> DataFrame:
    """The class of each case; any but ``perfect`` puts its document up for review."""
    kind = (
        F.when(F.col("agreement_score") == 0, "mismatch").when(F.col("agreement_score") == 0.5, "less_precise")
        .when(F.col("keyword_a") != F.col("keyword_b"), "match").when(F.col("certainty_a") != F.col("certainty_b"), "certainty_differs").otherwise("perfect")
    )
    return evaluations.withColumn("case_class", kind)


def consensus(a: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Annotation a with its settled conflicts, and whether its document is agreed.

    Equal values of different certainty take the lower one; where one side of a
    mismatch isn't certain at all the other side's value stands.
    """
    c = consensus_classes(evaluations)
    review = c.where("case_class <> 'perfect'").select("data_id").distinct().withColumn("conflict", F.lit(True))
    lower = F.col("certainty_b") < F.col("certainty_a")
    from_b = F.when(F.col("case_class") == "certainty_differs", lower).otherwise(F.col("certainty_a") == 0)
    fix = c.where("case_class = 'certainty_differs' or (case_class = 'mismatch' and (certainty_a = 0 or certainty_b = 0))").select(
        *scoring.KEYS, F.when(from_b, F.struct(F.col("keyword_b").alias("k"), F.col("certainty_b").alias("c"), F.col("hardness_b").alias("h"))).otherwise(F.struct(F.col("keyword_a").alias("k"), F.col("certainty_a").alias("c"), F.col("hardness_a").alias("h"))).alias("fix")
    )
    out = a.join(fix, scoring.KEYS, "left").join(review, "data_id", "left")
    return out.select(*scoring.KEYS, "pos", F.coalesce("fix.k", "keyword").alias("keyword"), F.coalesce("fix.c", "certainty").alias("certainty"), F.coalesce("fix.h", "hardness").alias("hardness"), F.when(F.col("conflict"), "conflict").otherwise("agreed").alias("part"))
