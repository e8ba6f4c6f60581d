"""Inference of people's attributes from texts: analysis, two profiles, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import prompts
from veilframe.functions.parse import analysis_part, normalized_pii, subject_count
from veilframe.functions.repair import parse_profiles
from veilframe.operators.alignment import description_jaccard, keep_first, prefer_first
from veilframe.sources.folders import work_folder, written
from veilframe.sources.ledger import Ledger


def analysis(answers: DataFrame) -> DataFrame:
    """Adds number_of_subjects, analysis and status (success or error) to answers (data_id, response)."""
    part = analysis_part(F.col("response"))
    n = subject_count(F.col("response"))
    return answers.withColumn("number_of_subjects", n).withColumn("analysis", part["text"]).withColumn("analysis_status", F.when(n.isNull() | (part["status"] == "error"), "error").otherwise("success"))


def profile_prompts(documents: DataFrame, analysed: DataFrame, code: bool) -> DataFrame:
    return documents.join(analysed.where("analysis_status = 'success'").select("data_id", "analysis"), "data_id").withColumn("prompt", prompts.profile(F.col("text"), F.col("analysis"), code))


def long_profiles(answers: DataFrame) -> DataFrame:
    """data_id, subject_id, subject_pos, description, tag, pos, keyword, certainty, hardness of profile answers; the first value of a tag counts."""
    return long_parsed(parse_profiles(answers, "response"))


def long_parsed(parsed: DataFrame) -> DataFrame:
    """``long_profiles`` of answers that are parsed."""
    people = parsed.where("parsed.status = 'success'").select("data_id", F.posexplode("parsed.subjects").alias("subject_pos", "s"))
    flat = people.select("data_id", F.col("s.id").alias("subject_id"), "subject_pos", "s.description", F.posexplode("s.PIIs").alias("pos", "p")).select("data_id", "subject_id", "subject_pos", "description", "p.tag", "pos", "p.keyword", "p.certainty", "p.hardness")
    return keep_first(flat.where("tag is not null"), ["data_id", "subject_id", "tag"], "pos")


def rekeyed(first: DataFrame, second: DataFrame, least: float = 0.5) -> DataFrame:
    """``second`` with ids of ``first`` for people whom only their descriptions match.

    Ids that only ``first`` has are served in ascending order: each takes the
    most similar description, of equal ones the smallest id, that no id before
    it took, if they share more than ``least`` of their words.  An id of 0 that
    only ``second`` has is never taken.
    """
    ids = lambda d: d.groupBy("data_id", "subject_id").agg(F.first("description").alias("description"))
    a, b = ids(first), ids(second)
    lone_a = a.join(b, ["data_id", "subject_id"], "left_anti")
    lone_b = b.join(a, ["data_id", "subject_id"], "left_anti").withColumnsRenamed({"subject_id": "other", "description": "other_description"})
    pairs = lone_a.join(lone_b, "data_id").withColumn("s", description_jaccard(F.col("description"), F.col("other_description"))).where((F.col("s") > least) & (F.col("other") != 0))
    best = pairs.groupBy("data_id").agg(F.array_sort(F.collect_list(F.struct("subject_id", (-F.col("s")).alias("s"), "other"))).alias("p"))
    zero = F.array().cast("array<struct<subject_id:int,other:int>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["subject_id"] == x["subject_id"]) | (y["other"] == x["other"]))
    picked = F.aggregate("p", zero, lambda acc, x: F.when(free(acc, x), F.array_append(acc, F.struct(x["subject_id"].cast("int").alias("subject_id"), x["other"].cast("int").alias("other")))).otherwise(acc))
    match = best.select("data_id", F.explode(picked).alias("m")).select("data_id", F.col("m.subject_id").alias("new_id"), F.col("m.other").alias("subject_id"))
    return second.join(match, ["data_id", "subject_id"], "left").withColumn("subject_id", F.coalesce("new_id", "subject_id")).drop("new_id")


def merged_profiles(code: DataFrame, free: DataFrame, allow_fallback: bool = True) -> DataFrame:
    """Both profiles by person and tag, values that say nothing blanked.

    Documents without a code profile come from the other one alone if
    ``allow_fallback``, else they go.  Alone, people take their place in the
    answer (``subject_pos``, if there) for an id, whatever id it gave them.
    """
    keys = ["data_id", "subject_id", "tag", "keyword", "certainty", "hardness"]
    if not allow_fallback:
        free = free.join(code.select("data_id").distinct(), "data_id", "left_semi")
    elif "subject_pos" in free.columns:
        lone = free.join(code.select("data_id").distinct(), "data_id", "left_anti").withColumn("subject_id", F.col("subject_pos").cast(free.schema["subject_id"].dataType))
        free = free.join(code.select("data_id").distinct(), "data_id", "left_semi").unionByName(lone)
    both = prefer_first(code.select(*keys), rekeyed(code, free).select(*keys))
    n = normalized_pii(F.col("keyword"), F.coalesce("certainty", F.lit(0)), F.coalesce("hardness", F.lit(1)))
    return both.withColumn("_n", n).select("data_id", "subject_id", "tag", "_n.*")


def with_repair(answers: DataFrame, backend, ledger: Ledger | None = None) -> DataFrame:
    """Parsed profile answers (data_id, response); what can't be read goes to a model once, with the request to mend it.

    Adds parsed (as ``parse_profiles``) and repaired: whether the answer had to be
    mended.  Every row stays, whatever its id.  The model's answers are kept in
    ``ledger``; unreadable answers that are equal are one call.
    """
    ledger = ledger or Ledger(answers.sparkSession)
    read = parse_profiles(answers.select("data_id", "response"), "response").withColumnsRenamed({"response": "_first", "parsed": "_read"})
    lost = (F.col("_read.status") == "error") & (F.trim(F.coalesce("_first", F.lit(""))) != "")
    told = ledger.ask(read.withColumn("_prompt", F.when(lost, prompts.mend(F.col("_first"), F.coalesce("_read.error", F.lit(""))))), backend, "mend", "_prompt")
    mended = parse_profiles(told.withColumn("_again", F.when(F.col("_prompt").isNotNull() & (F.col("status") == "success"), F.col("response"))), "_again")
    repaired = F.coalesce(F.col("_again").isNotNull() & (F.col("parsed.status") == "success"), F.lit(False))
    return mended.select("data_id", F.when(repaired, F.col("_again")).otherwise(F.col("_first")).alias("response"), F.when(repaired, F.col("parsed")).otherwise(F.col("_read")).alias("parsed"), repaired.alias("repaired"))


def run(documents: DataFrame, backend, dataset: str = "panorama", ledger: Ledger | None = None, attempts: int = 1, allow_fallback: bool = True) -> dict[str, DataFrame]:
    """The whole inference of documents (data_id, text): people counted, profiled twice, mended, merged.

    Each stage asks through ``ledger``, so a run that is started again asks only
    what it lacks.  Returns profiles (a row per person and tag) and errors
    (data_id, error_type, error) of documents whose analysis or both profiles
    failed.
    """
    ledger = ledger or Ledger(documents.sparkSession)
    docs = documents.select("data_id", "text")
    counted = ledger.ask(docs.withColumn("prompt", prompts.count_people(F.col("text"), dataset)), backend, "analysis", attempts=attempts)
    analysed = analysis(counted.select("data_id", "status", "response"))
    analysed = analysed.withColumn("analysis_status", F.when(F.col("status") == "success", F.col("analysis_status")).otherwise("error"))

    def profiles(code: bool) -> DataFrame:
        name = "profile-code" if code else "profile-free"
        told = ledger.ask(profile_prompts(docs, analysed, code), backend, name, attempts=attempts)
        return with_repair(told.where("status = 'success'"), backend, ledger)

    code, free = written(profiles(True), work_folder(documents.sparkSession), "code"), written(profiles(False), work_folder(documents.sparkSession), "free")
    merged = merged_profiles(long_parsed(code), long_parsed(free), allow_fallback)
    read = code.unionByName(free).where("parsed.status = 'success'").select("data_id").distinct()
    bad = analysed.where("analysis_status <> 'success'").select("data_id", F.lit("analysis").alias("error_type"), F.when(F.col("status") == "success", "no count of people in the answer").otherwise(F.col("response")).alias("error"))
    unread = analysed.where("analysis_status = 'success'").select("data_id").distinct().join(read, "data_id", "left_anti").select("data_id", F.lit("profile").alias("error_type"), F.lit("no profile could be read").alias("error"))
    return {"profiles": merged, "errors": bad.unionByName(unread)}
