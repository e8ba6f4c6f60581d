"""The registered queries of the library's own operators, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe import fixtures as fx
from veilframe.functions import agreement, parse
from veilframe.functions import text as tx
from veilframe.functions.similarity import jaro_winkler_udf
from veilframe.operators import alignment, entities, privacy, scoring, spans, stats
from veilframe.plans import evaluate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ann(spark, sf_dir):
    return fx.spark_view(spark, sf_dir, "ann_a"), fx.spark_view(spark, sf_dir, "ann_b")


def evaluations(spark, sf_dir):
    return scoring.gt_evaluations(*ann(spark, sf_dir))


# --- The scored pairs in DuckDB's SQL ------------------------------------------------

ANN = f"a AS ({fx.duck_view('ann_a')}), b AS ({fx.duck_view('ann_b')})"
PAIRS = f"""{ANN},
 gp AS (SELECT a.data_id, a.subject_id, a.tag, a.pos AS pos_a, a.keyword AS keyword_a, a.certainty AS certainty_a, a.hardness AS hardness_a, b.pos AS pos_b, b.keyword AS keyword_b, b.certainty AS certainty_b, b.hardness AS hardness_b
   FROM a LEFT JOIN (SELECT * FROM b WHERE certainty <> 0) b ON a.data_id = b.data_id AND a.subject_id = b.subject_id AND a.tag = b.tag WHERE a.keyword <> '')"""


def scored_sql(pairs: str) -> str:
    """CTEs jwp .. sc that score the rows of the CTE ``pairs``."""
    return f"""
 nm AS (SELECT *, coalesce(keyword_a, '') AS ka, coalesce(keyword_b, '') AS kb, lower(trim(coalesce(keyword_a, ''))) AS x, lower(trim(coalesce(keyword_b, ''))) AS y FROM {pairs}),
 jwp AS (SELECT DISTINCT x, y FROM nm WHERE tag IN ('NAME', 'AFFILIATION') AND ka <> '' AND kb <> '' AND x <> y),
 jwm(x, y, i, used, lm) AS (SELECT x, y, 0, CAST([] AS INT[]), '' FROM jwp UNION ALL
   SELECT x, y, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN lm ELSE lm || substr(x, i + 1, 1) END FROM (
     SELECT x, y, i, used, lm, CAST(list_min(list_filter(generate_series(greatest(1, i + 2 - greatest(length(x), length(y)) // 2), least(length(y), i + greatest(length(x), length(y)) // 2)), lambda k: substr(y, k, 1) = substr(x, i + 1, 1) AND NOT list_contains(used, CAST(k AS INT)))) AS INT) AS j FROM jwm WHERE i < length(x))),
 jw0 AS (SELECT x, y, len(used) AS m, length(x) AS l1, length(y) AS l2, len(list_filter(generate_series(1, len(used)), lambda p: substr(lm, p, 1) <> substr(y, list_sort(used)[p], 1))) AS t,
     CASE WHEN substr(x,1,1) <> substr(y,1,1) THEN 0 WHEN length(x) < 2 OR length(y) < 2 OR substr(x,2,1) <> substr(y,2,1) THEN 1 WHEN length(x) < 3 OR length(y) < 3 OR substr(x,3,1) <> substr(y,3,1) THEN 2 WHEN length(x) < 4 OR length(y) < 4 OR substr(x,4,1) <> substr(y,4,1) THEN 3 ELSE 4 END AS pre FROM jwm WHERE i = length(x)),
 jw AS (SELECT x, y, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE j + pre * 0.1::DOUBLE * (1 - j) END AS sim FROM (SELECT *, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m::DOUBLE / l1 + m::DOUBLE / l2 + (m - t / 2.0::DOUBLE) / m) / 3.0::DOUBLE END AS j FROM jw0)),
 lv AS (SELECT nm.*, sim, list_reverse(list_filter([trim(z) for z in string_split(replace(x, 'turkey', 'türkiye'), '/')], lambda z: z <> '')) AS la, list_reverse(list_filter([trim(z) for z in string_split(replace(y, 'turkey', 'türkiye'), '/')], lambda z: z <> '')) AS lb,
     replace(trim(ka), '–', '-') AS ga, replace(trim(kb), '–', '-') AS gb, upper(regexp_replace(ka, '[^a-zA-Z0-9]', '', 'g')) AS ia, upper(regexp_replace(kb, '[^a-zA-Z0-9]', '', 'g')) AS ib FROM nm LEFT JOIN jw USING (x, y)),
 lw AS (SELECT *, greatest(len(la), len(lb)) AS dp, least(len(la), len(lb)) AS sh, TRY_CAST(split_part(ga, '-', 1) AS INT) AS al, TRY_CAST(split_part(ga, '-', 2) AS INT) AS ah, TRY_CAST(split_part(gb, '-', 1) AS INT) AS bl, TRY_CAST(split_part(gb, '-', 2) AS INT) AS bh, TRY_CAST(ga AS INT) AS av, TRY_CAST(gb AS INT) AS bv, contains(ga, '-') AS ra, contains(gb, '-') AS rb FROM lv),
 lx AS (SELECT *, len(list_filter(generate_series(1, sh), lambda i: la[i] = lb[i])) AS eq,
     CASE WHEN tag <> 'AGE' OR ka = '' OR kb = '' THEN false WHEN ra AND rb THEN al IS NULL OR ah IS NULL OR bl IS NULL OR bh IS NULL WHEN regexp_full_match(ga, '[0-9]+') AND regexp_full_match(gb, '[0-9]+') THEN false WHEN ra THEN al IS NULL OR ah IS NULL OR bv IS NULL WHEN rb THEN bl IS NULL OR bh IS NULL OR av IS NULL ELSE false END AS error,
     CASE WHEN x IN ('male','m','man') AND y IN ('male','m','man') OR x IN ('female','f','woman') AND y IN ('female','f','woman') THEN 'SEX'
       WHEN x IN ('no relation','single','unmarried') AND y IN ('no relation','single','unmarried') OR x IN ('in relation','dating','relationship') AND y IN ('in relation','dating','relationship') OR x IN ('married','wed') AND y IN ('married','wed') OR x IN ('divorced','separated') AND y IN ('divorced','separated') OR x IN ('widowed','widow','widower') AND y IN ('widowed','widow','widower') THEN 'RELATIONSHIP' END AS syn FROM lw),
 sc AS (SELECT *, CAST(CASE WHEN ka = '' AND kb = '' THEN 1 WHEN ka = '' OR kb = '' THEN 0
     WHEN tag = 'AGE' THEN CASE WHEN error THEN 0 WHEN ra AND rb THEN CASE WHEN greatest(0, least(ah, bh) - greatest(al, bl)) / greatest(least(ah - al, bh - bl), 1)::DOUBLE >= 0.75 THEN 1 ELSE 0 END
        WHEN regexp_full_match(ga, '[0-9]+') AND regexp_full_match(gb, '[0-9]+') THEN CASE WHEN abs(av - bv) <= 5 THEN 1 ELSE 0 END WHEN ra THEN CASE WHEN bv BETWEEN al AND ah THEN 1 ELSE 0 END WHEN rb THEN CASE WHEN av BETWEEN bl AND bh THEN 1 ELSE 0 END ELSE 0 END
     WHEN tag = 'LOCATION' THEN CASE WHEN x = y THEN 1 WHEN len(la) <> len(lb) AND sh > 0 AND la[1:sh] = lb[1:sh] THEN 0.5 WHEN eq = dp THEN 1 WHEN eq = dp - 1 THEN 0.5 ELSE 0 END
     WHEN tag IN ('SEX', 'RELATIONSHIP') THEN CASE WHEN x = y OR syn = tag THEN 1 ELSE 0 END
     WHEN tag = 'IDENTIFICATION_NUMBER' THEN CASE WHEN ia = ib OR ((ends_with(ia, ib) OR ends_with(ib, ia)) AND abs(length(ia) - length(ib)) <= 3) THEN 1 ELSE 0 END
     WHEN tag = 'EMAIL_ADDRESS' THEN CASE WHEN x = y THEN 1 ELSE 0 END
     ELSE CASE WHEN x = y OR sim >= 0.85 THEN 1 ELSE 0 END END AS DOUBLE) AS score FROM lx)"""


EV = f"""{PAIRS}, {scored_sql('gp')},
 bs AS (SELECT *, CASE WHEN pos_b IS NULL THEN 0.0 ELSE score END AS fs, bool_or(error) OVER (PARTITION BY data_id, subject_id) AS bad FROM sc),
 ev AS (SELECT data_id, subject_id, tag, keyword_a, kb AS keyword_b, certainty_a, coalesce(certainty_b, 0) AS certainty_b, hardness_a, coalesce(hardness_b, 0) AS hardness_b, CAST(fs AS DOUBLE) AS agreement_score, 'RULE' AS evaluation_method, fs >= 1 AS match, fs > 0 AND fs < 1 AS less_precise, fs = 0 AS mismatch
   FROM (SELECT *, row_number() OVER (PARTITION BY data_id, subject_id, tag ORDER BY fs DESC, pos_a, pos_b) AS rn FROM bs) WHERE rn = 1 AND NOT bad)"""
IEV = f"""{ANN},
 fa AS (SELECT data_id, subject_id, tag, arg_min(certainty, pos) AS fa FROM a GROUP BY ALL), fb AS (SELECT data_id, subject_id, tag, arg_min(certainty, pos) AS fb FROM b GROUP BY ALL),
 hd AS (SELECT * FROM fa FULL JOIN fb USING (data_id, subject_id, tag)),
 ip AS (SELECT h.data_id, h.subject_id, h.tag, a.pos AS pos_a, a.keyword AS keyword_a, a.certainty AS certainty_a, a.hardness AS hardness_a, b.pos AS pos_b, b.keyword AS keyword_b, b.certainty AS certainty_b, b.hardness AS hardness_b
   FROM hd h JOIN a USING (data_id, subject_id, tag) LEFT JOIN b USING (data_id, subject_id, tag) WHERE (fa >= 2 OR fb >= 2) AND (b.pos IS NULL OR a.certainty <> 0 OR b.certainty <> 0)), {scored_sql('ip')},
 lost AS (SELECT DISTINCT data_id, subject_id FROM hd WHERE fa IS NULL OR (fb IS NULL AND fa < 2)),
 ibs AS (SELECT *, CASE WHEN pos_b IS NULL THEN 0.0 ELSE score END AS fs, bool_or(error) OVER (PARTITION BY data_id, subject_id) AS bad FROM sc),
 ev AS (SELECT data_id, subject_id, tag, keyword_a, kb AS keyword_b, certainty_a, coalesce(certainty_b, 0) AS certainty_b, hardness_a, coalesce(hardness_b, 0) AS hardness_b, CAST(fs AS DOUBLE) AS agreement_score, 'RULE' AS evaluation_method, fs >= 1 AS match, fs > 0 AND fs < 1 AS less_precise, fs = 0 AS mismatch
   FROM (SELECT *, row_number() OVER (PARTITION BY data_id, subject_id, tag ORDER BY fs DESC, pos_a, pos_b) AS rn FROM ibs) WHERE rn = 1 AND NOT bad AND (data_id, subject_id) NOT IN (SELECT (data_id, subject_id) FROM lost))"""


def with_ev(sql: str) -> str:
    return f"WITH RECURSIVE {EV} {sql}"


SUBJ = "sp AS (SELECT data_id, subject_id, count(*) FILTER (certainty_a >= 3) AS attributes, coalesce(sum(agreement_score) FILTER (certainty_a >= 3), 0.0) AS score_sum FROM ev GROUP BY ALL), sq AS (SELECT *, CASE WHEN attributes > 0 THEN 1 - score_sum / attributes END AS protection FROM sp)"


# --- Privacy ------------------------------------------------------------------------


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("ipr_cpr", with_ev(f", {SUBJ} SELECT count(protection) AS num_subjects, CAST(sum(attributes) AS BIGINT) AS num_pii, round(coalesce(avg(protection), 0), 6) AS ipr, round(1 - sum(score_sum) / sum(attributes), 6) AS cpr FROM sq"))
def ipr_cpr(spark, sf_dir):
    return rounded(privacy.ipr_cpr(evaluations(spark, sf_dir)), "ipr", "cpr")


@register("subject_protection", with_ev(f", {SUBJ} SELECT data_id, subject_id, attributes, score_sum, round(protection, 6) AS protection FROM sq"))
def subject_protection(spark, sf_dir):
    return rounded(privacy.subject_protection(evaluations(spark, sf_dir)), "protection")


@register("ipr_by_doc", with_ev(f", {SUBJ} SELECT data_id, count(protection) AS num_subjects, CAST(sum(attributes) AS BIGINT) AS num_pii, round(coalesce(avg(protection), 0), 6) AS ipr, round(coalesce(1 - sum(score_sum) / nullif(sum(attributes), 0), 0), 6) AS cpr FROM sq GROUP BY data_id"))
def ipr_by_doc(spark, sf_dir):
    return rounded(privacy.ipr_cpr(evaluations(spark, sf_dir), by=["data_id"]), "ipr", "cpr")


@register("cpr_by_tag", with_ev("SELECT tag, round(1 - sum(agreement_score) / count(*), 6) AS cpr, count(*) AS num_pii, sum(agreement_score) AS score_sum FROM ev WHERE certainty_a >= 3 GROUP BY tag"))
def cpr_by_tag(spark, sf_dir):
    return rounded(privacy.cpr_by_tag(evaluations(spark, sf_dir)), "cpr")


@register("cpr_grouping_sets", with_ev("SELECT tag, round(1 - sum(agreement_score) / count(*), 6) AS cpr, count(*) AS num_pii FROM ev WHERE certainty_a >= 3 GROUP BY GROUPING SETS ((tag), ())"))
def cpr_grouping_sets(spark, sf_dir):
    return rounded(privacy.cpr_grouping_sets(evaluations(spark, sf_dir)), "cpr")


AGREE = "count(*) AS total_comparisons, count(*) FILTER (match) AS total_matches, count(*) FILTER (less_precise) AS total_less_precise, count(*) FILTER (mismatch) AS total_mismatches, round(count(*) FILTER (match) / count(*)::DOUBLE, 6) AS match_rate, round(count(*) FILTER (less_precise) / count(*)::DOUBLE, 6) AS less_precise_rate, round(count(*) FILTER (mismatch) / count(*)::DOUBLE, 6) AS mismatch_rate, round(avg(agreement_score), 6) AS average_score"
RATES = ("match_rate", "less_precise_rate", "mismatch_rate", "average_score")


@register("agreement_stats", with_ev(f"SELECT {AGREE} FROM ev WHERE certainty_a >= 3"))
def agreement_stats(spark, sf_dir):
    return rounded(stats.agreement_stats(evaluations(spark, sf_dir), 3), *RATES)


@register("agreement_by_tag", with_ev(f"SELECT tag, {AGREE} FROM ev GROUP BY tag"))
def agreement_by_tag(spark, sf_dir):
    return rounded(stats.agreement_by_tag(evaluations(spark, sf_dir)), *RATES)


@register("agreement_by_tag_topk", with_ev("SELECT tag, round(avg(agreement_score), 6) AS average_score, count(*) AS total_comparisons FROM ev GROUP BY tag ORDER BY avg(agreement_score) DESC, tag LIMIT 5"))
def agreement_by_tag_topk(spark, sf_dir):
    return rounded(stats.tags_by_score(evaluations(spark, sf_dir), 5), "average_score")


@register(
    "certainty_buckets",
    with_ev("""SELECT CAST(k AS INT) AS min_certainty, count(*) AS total_comparisons, count(*) FILTER (match) AS total_matches, count(*) FILTER (less_precise) AS total_less_precise, count(*) FILTER (mismatch) AS total_mismatches, round(avg(agreement_score), 6) AS average_score
      FROM ev JOIN (SELECT unnest(generate_series(0, 5)) AS k) ON certainty_a >= k GROUP BY k"""),
)
def certainty_buckets(spark, sf_dir):
    return rounded(stats.certainty_buckets(evaluations(spark, sf_dir)), "average_score")


@register(
    "case_logs",
    with_ev("""SELECT data_id, subject_id, CASE WHEN agreement_score = 0 THEN '0.0' WHEN agreement_score = 0.5 THEN '0.5' WHEN keyword_a <> keyword_b THEN '1.0-differs' ELSE '1.0' END AS case_group,
      concat('[', data_id, '][', subject_id, '] [RULE] [', tag, '] ''', keyword_a, ''' vs ''', keyword_b, ''' | score=', agreement_score) AS log FROM ev WHERE agreement_score < 1"""),
)
def case_logs(spark, sf_dir):
    return stats.case_logs(evaluations(spark, sf_dir), "disagree")


# --- Scalars of agreement ----------------------------------------------------------------


def scored(spark, sf_dir, *tags):
    a, b = ann(spark, sf_dir)
    pairs = scoring._sided(a.where("keyword <> ''"), "a").join(scoring._sided(b.where("certainty <> 0"), "b"), scoring.KEYS, "left").where(F.col("tag").isin(*tags))
    return scoring.rule_scores(pairs).select("data_id", "subject_id", "tag", "pos_a", "pos_b", "keyword_a", "keyword_b", "score", "error")


def scored_oracle(*tags):
    names = ", ".join(f"'{t}'" for t in tags)
    return f"WITH RECURSIVE {PAIRS}, {scored_sql('gp')} SELECT data_id, subject_id, tag, pos_a, CAST(pos_b AS INT) AS pos_b, keyword_a, keyword_b, score, error FROM sc WHERE tag IN ({names})"


for _name, _tags in {"location_agreement": ("LOCATION",), "age_agreement": ("AGE",), "identifier_agreement": ("IDENTIFICATION_NUMBER",), "categorical_agreement": ("SEX", "RELATIONSHIP"), "email_agreement": ("EMAIL_ADDRESS",), "free_text_agreement": ("NAME", "AFFILIATION")}.items():
    register(_name, scored_oracle(*_tags))(lambda spark, sf_dir, tags=_tags: scored(spark, sf_dir, *tags))


@register("jaro_winkler", f"WITH RECURSIVE {PAIRS}, {scored_sql('gp')} SELECT x AS a, y AS b, round(sim, 9) AS similarity FROM jw")
def jaro_winkler(spark, sf_dir):
    a, b = ann(spark, sf_dir)
    pairs = scoring._sided(a.where("keyword <> ''"), "a").join(scoring._sided(b.where("certainty <> 0"), "b"), scoring.KEYS)
    wanted = pairs.where(agreement.needs_similarity(F.col("keyword_a"), F.col("keyword_b"), F.col("tag"))).select(tx.plain(F.col("keyword_a")).alias("a"), tx.plain(F.col("keyword_b")).alias("b")).distinct()
    return wanted.withColumn("similarity", F.round(jaro_winkler_udf("a", "b"), 9))


EV_COLUMNS = "data_id, subject_id, tag, keyword_a, keyword_b, certainty_a, certainty_b, hardness_a, hardness_b, agreement_score, evaluation_method, match, less_precise, mismatch"


@register("best_pair_per_tag", with_ev(f"SELECT {EV_COLUMNS} FROM ev"))
def best_pair_per_tag(spark, sf_dir):
    return evaluations(spark, sf_dir)


@register("inter_evaluations", f"WITH RECURSIVE {IEV} SELECT {EV_COLUMNS} FROM ev")
def inter_evaluations(spark, sf_dir):
    return scoring.inter_evaluations(*ann(spark, sf_dir), min_certainty=2)


@register("subject_error_drop", f"WITH RECURSIVE {PAIRS}, {scored_sql('gp')} SELECT data_id, subject_id, count(*) AS failed_pairs FROM sc WHERE error GROUP BY ALL")
def subject_error_drop(spark, sf_dir):
    return scored(spark, sf_dir, "AGE").where("error").groupBy("data_id", "subject_id").agg(F.count(F.lit(1)).alias("failed_pairs"))


CLASS = "CASE WHEN agreement_score = 0 THEN 'mismatch' WHEN agreement_score = 0.5 THEN 'less_precise' WHEN keyword_a <> keyword_b THEN 'match' WHEN certainty_a <> certainty_b THEN 'certainty_differs' ELSE 'perfect' END"


@register(
    "consensus_split",
    f"""WITH RECURSIVE {IEV}, cl AS (SELECT *, {CLASS} AS c FROM ev),
    fx AS (SELECT data_id, subject_id, tag, CASE WHEN c = 'certainty_differs' THEN certainty_b < certainty_a ELSE certainty_a = 0 END AS fb, * EXCLUDE (data_id, subject_id, tag) FROM cl WHERE c = 'certainty_differs' OR (c = 'mismatch' AND (certainty_a = 0 OR certainty_b = 0)))
    SELECT a.data_id, a.subject_id, a.tag, a.pos, CASE WHEN fx.fb THEN fx.keyword_b WHEN NOT fx.fb THEN fx.keyword_a ELSE a.keyword END AS keyword, CASE WHEN fx.fb THEN fx.certainty_b WHEN NOT fx.fb THEN fx.certainty_a ELSE a.certainty END AS certainty,
      CASE WHEN fx.fb THEN fx.hardness_b WHEN NOT fx.fb THEN fx.hardness_a ELSE a.hardness END AS hardness, CASE WHEN a.data_id IN (SELECT data_id FROM cl WHERE c <> 'perfect') THEN 'conflict' ELSE 'agreed' END AS part
    FROM a LEFT JOIN fx USING (data_id, subject_id, tag)""",
)
def consensus_split(spark, sf_dir):
    a, b = ann(spark, sf_dir)
    return evaluate.consensus(a, scoring.inter_evaluations(a, b, min_certainty=2))


@register(
    "decider_fallback",
    f"""WITH RECURSIVE {PAIRS}, {scored_sql('gp')} SELECT data_id, subject_id, tag, pos_a, CAST(pos_b AS INT) AS pos_b,
      CASE WHEN score = 0 AND NOT error THEN CASE WHEN x = '' OR y = '' THEN 0.0 WHEN length(x) = length(y) THEN 1.0 WHEN length(x) > length(y) THEN 0.5 ELSE 0.0 END::DOUBLE ELSE score END AS score, CASE WHEN score = 0 AND NOT error THEN 'MODEL' ELSE 'RULE' END AS method FROM sc""",
)
def decider_fallback(spark, sf_dir):
    """Zero scores decided by replayed answers: yes for equal lengths, less precise for shorter guesses."""
    a, b = ann(spark, sf_dir)
    pairs = scoring._sided(a.where("keyword <> ''"), "a").join(scoring._sided(b.where("certainty <> 0"), "b"), scoring.KEYS, "left")
    ruled = scoring.rule_scores(pairs)
    x, y = tx.plain(F.coalesce("keyword_a", F.lit(""))), tx.plain(F.coalesce("keyword_b", F.lit("")))
    said = F.when((x == "") | (y == ""), "No").when(F.length(x) == F.length(y), "Yes.").when(F.length(x) > F.length(y), "less precise").otherwise("no")
    answers = scoring.questions(ruled).withColumn("response", said)
    return scoring.decided(ruled, evaluate.model_decisions(answers)).select("data_id", "subject_id", "tag", "pos_a", "pos_b", "score", "method")
