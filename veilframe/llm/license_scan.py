"""License scan (operator 1), with DataFrame functions only.

Texts become lower-cased words, each with a space on both sides.  A text that
holds none of the root words is done.  Others try the signature rules whose
keyword they hold; each match is an interval of word positions.  Intervals are
sorted by start, longest first, then by priority and rule order: one that lies
within an interval before it is suppressed, so the longest reading of a passage
wins, and of equal readings the one of highest priority.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import places
from veilframe.llm.license_rules import BASE, ROOTS, rules, tried, wide

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


#: Characters other than A-Z whose lower case holds ASCII letters: the Kelvin sign and the dotted capital I.
FALSE_CAPITALS = "\u212a\u0130"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, as far as ASCII patterns can tell; other letters may change too, but not into ASCII."""
    odd = F.contains(text, F.lit(FALSE_CAPITALS[0])) | F.contains(text, F.lit(FALSE_CAPITALS[1]))
    return F.when(odd, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def spaced_words(text: Column) -> Column:
    """Lower-cased words, each between two spaces of its own; '' if there is none."""
    bare = F.btrim(F.regexp_replace(lower_ascii(text), NOT_WORD, "  "), F.lit(" "))
    return F.when(F.length(bare) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def n_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases and license labels of every text.

    Returns one row per input row: doc_id, n_words, n_base, first_word,
    last_word (null without a base phrase), base_labels, labels (distinct,
    sorted, comma-joined; '' if none), score (0 to 1, the priority of the best
    signature kept over 10, at least 0.6 with a base phrase), n_detections and
    n_suppressed.  Null and empty texts have no words; other columns of the
    table are not read; repeated ids give repeated rows.
    """
    rule = "array(" + ",".join(f"named_struct('n',{n},'p',{p},'l','{label}','k','{k}','r','{r}')" for n, p, label, k, r in tried()) + ")"
    spaced = docs.select(F.col(id_col).alias("doc_id"), spaced_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    gate = None
    for root in ROOTS:
        hit = F.contains(F.col("w"), F.lit(root))
        gate = hit if gate is None else gate | hit
    w = F.col("w")

    def labelled(label: str, phrase: str) -> Column:
        return F.transform(places(w, F.lit(wide(phrase)), n_words), lambda x: F.struct(x["s"].alias("s"), F.lit(label).alias("l")))

    base = [labelled(*b) for b in BASE]
    live = F.filter(F.expr(rule), lambda r: F.contains(w, r["k"]))
    found = F.flatten(
        F.transform(live, lambda r: F.transform(places(w, r["r"], n_words), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), (-r["p"]).alias("np"), r["n"].alias("n"), r["l"].alias("l"))))
    )
    zero = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).cast("long").alias("kept"))

    def keep(acc, d):
        inside = -d["ne"] <= acc["end"]
        labels = F.when(F.array_contains(acc["labels"], d["l"]), acc["labels"]).otherwise(F.array_append(acc["labels"], d["l"]))
        return F.when(inside, acc).otherwise(F.struct((-d["ne"]).alias("end"), labels.alias("labels"), F.greatest(acc["best"], -d["np"]).alias("best"), (acc["kept"] + 1).alias("kept")))

    none = "struct<b:array<struct<s:bigint,l:string>>,f:array<struct<s:bigint,ne:bigint,np:int,n:int,l:string>>>"
    got = F.when(gate, F.struct(F.concat(*base).alias("b"), F.array_sort(found).alias("f"))).otherwise(F.lit(None).cast(none))
    hits = spaced.select("doc_id", n_words(w).alias("n_words"), got.alias("got"))
    kept = hits.select("doc_id", "n_words", F.col("got.b").alias("b"), F.size(F.coalesce("got.f", F.array().cast("array<struct<s:bigint,ne:bigint,np:int,n:int,l:string>>"))).cast("long").alias("found"), F.aggregate(F.col("got.f"), zero, keep).alias("k"))
    base_labels = F.coalesce(F.array_distinct(F.col("b.l")), F.array().cast("array<string>"))
    labels = F.array_distinct(F.concat(base_labels, F.coalesce("k.labels", F.array().cast("array<string>"))))
    n_base = F.coalesce(F.size(F.col("b")), F.lit(0))
    n_base = F.when(F.col("b").isNull(), 0).otherwise(n_base).cast("long")
    best = F.coalesce("k.best", F.lit(0)) / F.lit(10.0)
    return kept.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.col("b.s")).alias("first_word"),
        F.array_max(F.col("b.s")).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(n_base > 0, F.greatest(best, F.lit(0.6))).otherwise(best).alias("score"),
        F.coalesce("k.kept", F.lit(0)).cast("long").alias("n_detections"),
        (F.col("found") - F.coalesce("k.kept", F.lit(0))).cast("long").alias("n_suppressed"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, by explicit rows for rules and matches."""
    table = ",".join(f"({n},{p},'{label}','{k}','{r}')" for n, p, label, k, r in rules())
    base = ",".join(f"('{label}','{wide(phrase)}')" for label, phrase in BASE)
    words = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS BIGINT)"
    starts = f"""
        list_sum([{words.format('g')} for g in gaps[1:i]]) + coalesce(list_sum([{words.format('h')} for h in hits[1:i - 1]]), 0)"""
    return f"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS b FROM documents),
    w AS (SELECT doc_id, CASE WHEN b = '' THEN '' ELSE ' ' || b || ' ' END AS w FROM t),
    rule(n, p, l, k, r) AS (VALUES {table}),
    base(l, r) AS (VALUES {base}),
    bm AS (SELECT doc_id, l, string_split_regex(w, r) AS gaps, regexp_extract_all(w, r) AS hits FROM w JOIN base ON regexp_matches(w, r)),
    bp AS (SELECT doc_id, l, {starts} AS s FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM bm)),
    b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT l) AS bl FROM bp GROUP BY doc_id),
    rm AS (SELECT doc_id, n, p, l, string_split_regex(w, r) AS gaps, regexp_extract_all(w, r) AS hits FROM w JOIN rule ON contains(w, k) AND regexp_matches(w, r)),
    rp AS (SELECT doc_id, n, p, l, {starts} AS s, {words.format('hits[i]')} AS len FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM rm)),
    ro AS (SELECT *, s + len AS e, max(s + len) OVER (PARTITION BY doc_id ORDER BY s, s + len DESC, p DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rp),
    k AS (SELECT doc_id, list(DISTINCT l) FILTER (before IS NULL OR e > before) AS kl, max(p) FILTER (before IS NULL OR e > before) AS best,
          count(*) FILTER (before IS NULL OR e > before) AS kept, count(*) AS found FROM ro GROUP BY doc_id)
    SELECT w.doc_id, {words.format('w')} AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(kl, [])))), ','), '') AS labels,
           greatest(coalesce(best, 0) / 10.0::DOUBLE, CASE WHEN n_base > 0 THEN 0.6::DOUBLE ELSE 0 END) AS score,
           coalesce(kept, 0) AS n_detections, coalesce(found, 0) - coalesce(kept, 0) AS n_suppressed
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
    """
