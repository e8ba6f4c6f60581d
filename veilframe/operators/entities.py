"""Entities, masks, recall and precision of anonymized documents.

Mentions are long: data_id, pos, entity_id, entity_type, identifier_type,
span_text, start_offset, end_offset (code points).  A document's masks are one
merged array of intervals; characters are never exploded.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.text import block_slice, blocks, let, mention_masked, merged, tokens

#: Characters of a bin in which intervals meet.
BIN = 256


def maskable():
    """Whether a mention needs masking."""
    return F.coalesce(F.upper("identifier_type") != "NO_MASK", F.lit(True))


def group_entities(mentions: DataFrame) -> DataFrame:
    """One row per document and entity; mentions without an entity id go.

    The type is the first mention's.  The identifier type is the first
    mention's, unless that needs no masking and a later one does: then it is the
    first maskable mention's.
    """
    m = mentions.where("entity_id is not null and entity_id <> ''")
    need = maskable()
    first_masked = F.min(F.when(need, F.struct("pos", "identifier_type")))["identifier_type"]
    return m.groupBy("data_id", "entity_id").agg(
        F.min_by("entity_type", "pos").alias("entity_type"), F.coalesce(first_masked, F.min_by("identifier_type", "pos")).alias("identifier_type"),
        F.count(F.lit(1)).alias("n_mentions"), F.count(F.when(need, 1)).alias("n_maskable"),
    )


def masks_of_entities(entities: DataFrame) -> DataFrame:
    """(data_id, masked) from the spans that an anonymizer reported."""
    return entities.groupBy("data_id").agg(merged(F.collect_list(F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e")))).alias("masked"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _occur(patterns: pd.Series, text: pd.Series) -> pd.Series:
    """Whether each pattern of a row occurs in its text: an automaton of the row's patterns passes the text once."""

    def one(words, whole):
        if whole is None:
            return [None] * len(words)
        searcher, found = ahocorasick.Automaton(), set()
        for w in words:
            if w:
                searcher.add_word(w, w)
        if len(searcher):
            searcher.make_automaton()
            for _, w in searcher.iter(whole):
                found.add(w)
                if len(found) == len(searcher):
                    break
        return [None if w is None else w == "" or w in found for w in words]

    return pd.Series([one(list(p), t) for p, t in zip(patterns, text)], dtype=object)


def spans_by_search(mentions: DataFrame, anonymized: DataFrame, automaton: bool = False) -> DataFrame:
    """Mentions whose text doesn't occur in the anonymized text any more.

    A document's mentions are put together, so its text is sent once.  It is
    searched for each mention in the JVM, or, for documents of thousands of
    mentions, passed once by an ``automaton`` of all of them, in Python.
    """
    own = mentions.where("span_text <> ''").groupBy("data_id").agg(F.collect_list(F.struct(*mentions.columns)).alias("_m"))
    both = own.join(anonymized.select("data_id", F.col("anonymized_text").alias("_text")), "data_id")
    if not automaton:
        return both.select(F.explode(F.filter("_m", lambda m: ~F.contains(F.col("_text"), m["span_text"]))).alias("x")).select("x.*")
    there = both.select("_m", _occur(F.col("_m.span_text"), F.col("_text")).alias("_there"))
    return there.select(F.explode(F.arrays_zip("_m", "_there")).alias("x")).where("not x._there").select("x._m.*")


def spans_by_offset(mentions: DataFrame, anonymized: DataFrame) -> DataFrame:
    """Mentions whose place in the anonymized text holds something else, or nothing."""
    there = F.substring("anonymized_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    gone = (F.length("anonymized_text") < F.col("end_offset")) | (there != F.col("span_text"))
    return mentions.join(anonymized.select("data_id", "anonymized_text"), "data_id").where(gone).drop("anonymized_text")


def detected_masks(mentions: DataFrame, anonymized: DataFrame, reported: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """(data_id, masked) of every anonymized document, by the chosen way of detection.

    auto takes the reported spans of documents that have any and searches spans
    in the others.
    """
    if method not in ("auto", "entities", "span_search", "offset_comparison"):
        raise ValueError(f"unknown detection method: {method}")
    spans = None
    if method in ("auto", "entities") and reported is not None:
        spans = reported.where("start_offset is not null and end_offset is not null").select("data_id", "start_offset", "end_offset")
    if method in ("auto", "span_search", "offset_comparison"):
        found = spans_by_offset(mentions, anonymized) if method == "offset_comparison" else spans_by_search(mentions, anonymized)
        if spans is not None:
            found = found.join(reported.select("data_id").distinct(), "data_id", "left_anti")
        found = found.select("data_id", "start_offset", "end_offset")
        spans = found if spans is None else spans.unionByName(found)
    base = anonymized.select("data_id").distinct()
    if spans is None:
        return base.withColumn("masked", F.array().cast("array<struct<s:int,e:int>>"))
    return base.join(masks_of_entities(spans), "data_id", "left").withColumn("masked", F.coalesce("masked", F.array().cast("array<struct<s:int,e:int>>")))


def cut_mentions(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (data_id, start_offset, end_offset, ...) with ``slice``, what they cover of their document's text.

    Each text meets its spans once, as one row, and is cut into blocks; what goes
    on are the slices.  Documents without spans and spans without a document go.
    """
    own = spans.groupBy("data_id").agg(F.collect_list(F.struct(*spans.columns)).alias("_m"))
    both = own.join(documents.select("data_id", F.col("text").alias("_text")), "data_id")
    piece = lambda b: F.transform("_m", lambda m: F.struct(m.alias("m"), block_slice(b, m["start_offset"], m["end_offset"]).alias("slice")))
    return both.select(F.explode(let(blocks(F.col("_text")), piece)).alias("x")).select("x.m.*", "x.slice")


def mention_recall(documents: DataFrame, mentions: DataFrame, masks: DataFrame) -> DataFrame:
    """Maskable mentions with ``is_masked`` and their numbers of tokens and masked tokens.

    Only a mention's slice of the text and the masks inside it are looked at.
    """
    m = mentions.where("entity_id is not null and entity_id <> ''").where(maskable()).select("data_id", "entity_id", "pos", "start_offset", "end_offset")
    m = cut_mentions(documents, m)
    a, b = F.col("start_offset"), F.col("end_offset")
    near = _masks_near(m, masks)
    zero, length = F.lit(0), F.col("end_offset") - F.col("start_offset")
    parts = tokens(F.col("slice"), zero, length)
    hit = F.filter(parts, lambda t: mention_masked(F.col("slice"), t["start_offset"], t["end_offset"], F.col("inside")))
    inside = F.transform("near", lambda x: F.struct((x["s"] - a).cast("int").alias("s"), (F.least(x["e"], b) - a).cast("int").alias("e")))
    inside = F.transform(inside, lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("s"), x["e"].alias("e")))
    near = near.withColumn("inside", inside)
    return near.select("data_id", "entity_id", "pos", mention_masked(F.col("slice"), zero, length, F.col("inside")).alias("is_masked"), F.size(parts).alias("n_tokens"), F.size(hit).alias("n_masked_tokens"))


def _masks_near(m: DataFrame, masks: DataFrame) -> DataFrame:
    """``m`` with ``near``: its document's masks that overlap it, in order; documents without a row of masks go.

    Masks are merged and so disjoint: they meet mentions by bins of text, each
    pair in one bin.
    """
    key = m.withColumn("_key", F.struct("entity_id", "pos", "start_offset", "end_offset"))
    own = masks.select("data_id", F.explode("masked").alias("x")).select("data_id", F.col("x.s").alias("_s"), F.col("x.e").alias("_e"))
    left = key.select("data_id", "_key", F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b")).distinct().withColumn("_bin", bins("_a", "_b"))
    met = left.join(own.withColumn("_bin", bins("_s", "_e")), ["data_id", "_bin"]).where((F.col("_s") < F.col("_b")) & (F.col("_e") > F.col("_a")) & (F.col("_bin") == F.floor(F.greatest("_a", "_s") / BIN)))
    found = met.groupBy("data_id", "_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("near"))
    known = key.join(masks.select("data_id"), "data_id", "left_semi")
    return known.join(found, ["data_id", "_key"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<s:int,e:int>>"))).drop("_key")


def bins(start: str, end: str):
    """A row for each bin of BIN characters that an interval touches."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(last / BIN)))


def entity_recall(documents: DataFrame, mentions: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per entity that needs masking: masked iff all its maskable mentions are."""
    found = mention_recall(documents, mentions, masks).groupBy("data_id", "entity_id").agg(
        F.bool_and("is_masked").alias("is_masked"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_masked_tokens").alias("n_masked_tokens")
    )
    return group_entities(mentions).where("n_maskable > 0").join(found, ["data_id", "entity_id"])


def _share(hit, whole):
    return F.coalesce(F.when(whole > 0, hit / whole), F.lit(0.0))


def _of(kind: str):
    is_kind = F.upper("identifier_type") == kind
    return F.count(F.when(is_kind & F.col("is_masked"), 1)), F.count(F.when(is_kind, 1))


def recall_report(entities: DataFrame, by_type: bool = False) -> DataFrame:
    """Recall of direct and quasi identifiers and of tokens, overall or by entity type."""
    (d, dn), (q, qn) = _of("DIRECT"), _of("QUASI")
    t, n = F.sum("n_masked_tokens"), F.sum("n_tokens")
    return entities.groupBy(*(["entity_type"] if by_type else [])).agg(
        d.alias("direct_masked"), dn.alias("direct_total"), q.alias("quasi_masked"), qn.alias("quasi_total"), F.coalesce(t, F.lit(0)).alias("tokens_masked"), F.coalesce(n, F.lit(0)).alias("tokens_total"),
        _share(d, dn).alias("erdi"), _share(q, qn).alias("erqi"), _share(t, n).alias("token_recall"),
    )


def system_tokens(documents: DataFrame, reported: DataFrame) -> DataFrame:
    """Word tokens of the spans that an anonymizer reported, with their places."""
    spans = reported.where("start_offset is not null and end_offset is not null").select("data_id", "start_offset", "end_offset")
    found = cut_mentions(documents, spans).select("data_id", "start_offset", F.explode(tokens(F.col("slice"), F.lit(0), F.length("slice"))).alias("t"))
    place = lambda c: (F.col(f"t.{c}") + F.col("start_offset")).alias(c)
    return found.select("data_id", "t.token", place("start_offset"), place("end_offset"))


def covered_tokens(system: DataFrame, mentions: DataFrame) -> DataFrame:
    """System tokens inside any maskable mention: a sweep over each document's tokens and mentions in order of their start.

    A token is inside one iff the mentions that begin no later reach as far as
    its end; only the furthest end so far is kept.
    """
    gold = mentions.where(maskable()).where("start_offset is not null and end_offset is not null")
    none = F.lit(None).cast(system.select(F.struct("*").alias("r")).schema["r"].dataType)
    end = F.lit(None).cast("int")
    events = system.select("data_id", F.col("start_offset").alias("at"), F.lit(1).alias("kind"), F.col("end_offset").alias("end"), F.struct("*").alias("row"), end.alias("reach"))
    events = events.unionAll(gold.select("data_id", "start_offset", F.lit(0), end, none, F.col("end_offset").cast("int")))
    over = Window.partitionBy("data_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.where("data_id is not null").withColumn("reach", F.max("reach").over(over))
    return swept.where((F.col("kind") == 1) & (F.col("reach") >= F.col("end"))).select("row.*")


def token_precision(documents: DataFrame, mentions: DataFrame, reported: DataFrame) -> DataFrame:
    """Share of masked tokens that had to be masked; null if nothing was reported."""
    system = system_tokens(documents, reported)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = system.select(zero.alias("tp"), one.alias("total")).unionAll(covered_tokens(system, mentions).select(one, zero))
    return rows.agg(F.coalesce(F.sum("tp"), zero).alias("tp"), F.coalesce(F.sum("total"), zero).alias("total")).withColumn("token_precision", F.when(F.col("total") > 0, F.col("tp") / F.col("total")))


def unmatched_documents(gold: DataFrame, anonymized: DataFrame) -> DataFrame:
    return gold.where("data_id is not null").join(anonymized.select("data_id"), "data_id", "left_anti").select("data_id")


# --- Two annotators' entities --------------------------------------------------


def match_entities(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """Entities of two annotators: each of a with the first of b at its start, then those left over.

    Scores are 1 for an equal type and end, 0.5 for an equal type.  ``compat``
    keeps only the first entity left over of either side in a document and
    repeats the last match beside each, as older reports count them; documents
    without a match, of which those reports hold nothing, are left out then.
    """
    cols = ["start_offset", "end_offset", "entity_type", "identifier_type"]
    x = a.select("data_id", F.col("pos").alias("a_pos"), *(F.col(c).alias(f"a_{c}") for c in cols))
    y = b.select("data_id", F.col("pos").alias("b_pos"), *(F.col(c).alias(f"b_{c}") for c in cols))
    first = y.withColumn("_rn", F.row_number().over(Window.partitionBy("data_id", "b_start_offset").orderBy("b_pos"))).where("_rn = 1").drop("_rn")
    left = x.join(first.withColumnRenamed("b_start_offset", "a_start_offset"), ["data_id", "a_start_offset"], "left").withColumn("matched", F.col("b_pos").isNotNull())
    same_end = F.when(F.col("a_end_offset") == F.col("b_end_offset"), 1.0).otherwise(0.5)

    def score(c: str):
        return F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), same_end).otherwise(0.0).alias(f"{c}_score")

    scored = left.select("data_id", "a_pos", "b_pos", "matched", score("entity_type"), score("identifier_type"))
    used = scored.where("matched").select("data_id", "b_pos").distinct()
    rest = y.join(used, ["data_id", "b_pos"], "left_anti").select("data_id", F.lit(None).cast("int").alias("a_pos"), "b_pos", F.lit(False).alias("matched"), F.lit(0.0).alias("entity_type_score"), F.lit(0.0).alias("identifier_type_score"))
    every = scored.unionByName(rest)
    if not compat:
        return every
    hits = every.where("matched")
    last = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("data_id").orderBy(F.desc("a_pos")))).where("_rn = 1").drop("_rn")
    misses = every.where("not matched").withColumn("_rn", F.row_number().over(Window.partitionBy("data_id", F.col("a_pos").isNull()).orderBy(F.coalesce("a_pos", "b_pos")))).where("_rn = 1").drop("_rn").join(last.select("data_id"), "data_id", "left_semi")
    again = last.join(misses.select("data_id"), "data_id").select(*hits.columns)
    return hits.unionByName(misses).unionByName(again)


def entity_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best partner of each entity of a: same type and text; equal span 1, overlapping or touching 0.5, else 0."""
    x = a.select("data_id", F.col("pos").alias("a_pos"), *(F.col(c).alias(f"a_{c}") for c in ("start_offset", "end_offset", "entity_type", "span_text")))
    y = b.select("data_id", F.col("pos").alias("b_pos"), *(F.col(c).alias(f"b_{c}") for c in ("start_offset", "end_offset", "entity_type", "span_text")))
    kind = (F.col("a_entity_type") == F.col("b_entity_type")) & (F.col("a_span_text") == F.col("b_span_text"))
    equal = (F.col("a_start_offset") == F.col("b_start_offset")) & (F.col("a_end_offset") == F.col("b_end_offset"))
    touch = (F.col("a_start_offset") <= F.col("b_end_offset")) & (F.col("b_start_offset") <= F.col("a_end_offset"))
    pairs = x.join(y, "data_id", "left").withColumn("score", F.when(kind & equal, 1.0).when(kind & touch, 0.5).otherwise(0.0))
    best = Window.partitionBy("data_id", "a_pos").orderBy(F.desc("score"), "b_pos")
    return pairs.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("data_id", "a_pos", F.when(F.col("score") > 0, F.col("b_pos")).alias("b_pos"), "score")


def best_overlap_label(spans: DataFrame, labelled: DataFrame, default: str = "MISC") -> DataFrame:
    """The label of the entity with the highest intersection over union, the first one on ties.

    Spans and entities meet by bins of text, each pair in one bin, and the best
    one is picked before anything is dealt by span.
    """
    e = labelled.select("data_id", F.col("pos").alias("e_pos"), F.col("start_offset").alias("e_s"), F.col("end_offset").alias("e_e"), F.col("entity_type").alias("label"))
    e = e.where("e_s < e_e").withColumn("bin", bins("e_s", "e_e"))
    s = spans.select("data_id", "pos", "start_offset", "end_offset")
    met = s.where("start_offset < end_offset").withColumn("bin", bins("start_offset", "end_offset")).join(e, ["data_id", "bin"])
    met = met.where((F.col("e_s") < F.col("end_offset")) & (F.col("e_e") > F.col("start_offset")) & (F.col("bin") == F.floor(F.greatest("start_offset", "e_s") / BIN)))
    inter = F.least("end_offset", "e_e") - F.greatest("start_offset", "e_s")
    iou = inter / (F.col("end_offset") - F.col("start_offset") + F.col("e_e") - F.col("e_s") - inter)
    found = met.select("data_id", "pos", iou.alias("iou"), (-F.col("e_pos")).alias("first"), "label")
    alone = s.select("data_id", "pos", F.lit(0.0).alias("iou"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("string").alias("label"))
    best = found.unionByName(alone).groupBy("data_id", "pos").agg(F.max_by(F.struct("iou", "label"), F.struct("iou", "first")).alias("b"))
    return best.select("data_id", "pos", F.coalesce("b.label", F.lit(default)).alias("entity_type"), "b.iou")


def merge_overlaps(mentions: DataFrame) -> DataFrame:
    """Overlapping mentions of a document as one span each, with the type of the longest (the first one on ties)."""
    w = Window.partitionBy("data_id").orderBy("start_offset", "end_offset", "pos")
    before = F.max("end_offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start_offset") >= before, F.lit(True)).cast("int")
    runs = mentions.withColumn("_run", F.sum(fresh).over(w))
    longest = F.struct((F.col("end_offset") - F.col("start_offset")).alias("n"), (-F.col("start_offset")).alias("s"), F.col("entity_type").alias("t"))
    return runs.groupBy("data_id", "_run").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.max(longest)["t"].alias("entity_type"), F.count(F.lit(1)).alias("n_merged")).drop("_run")


def drop_enumerators(mentions: DataFrame) -> DataFrame:
    """Without mentions that only number a list: ``1.``, ``(a)``, ``iv)``."""
    return mentions.where(~F.col("span_text").rlike(r"^\(?([0-9]{1,2}|[a-z]|[ivx]+)[.)]+$"))


#: Types of a general tagger's labels, and the words that its corrections look for (fixed values).
TAGGER_TYPES = {
    "PERSON": "PERSON", "ORG": "ORG", "GPE": "LOC", "LOC": "LOC", "FAC": "LOC", "LANGUAGE": "DEM", "NORP": "DEM", "PRODUCT": "MISC", "EVENT": "MISC", "WORK_OF_ART": "MISC",
    "DATE": "DATETIME", "TIME": "DATETIME", "PERCENT": "QUANTITY", "QUANTITY": "QUANTITY", "MONEY": "QUANTITY", "CARDINAL": "CODE",
}
TITLE = r"(?i)(?:^|\s|\()((?:mr|mrs|ms|dr)\.?|sir|prof|miss|judge|justice)(\s+)$"
REALM = r"((?:Kingdom|Republic) of\s+)$"
CURRENCY_SYMBOLS = ("$", "¥", "£", "€", "kr", "₽", "R$", "₹", "Rp", "₪", "zł", "Rs", "₺", "RS")
CURRENCY_CODES = (
    "USD", "EUR", "CNY", "JPY", "GBP", "NOK", "DKK", "CAD", "RUB", "MXN", "ARS", "BGN", "BRL", "CHF", "CLP", "CZK", "INR", "IDR", "ILS", "IRR", "IQD", "KRW", "KZT", "NGN",
    "QAR", "SEK", "SYP", "TRY", "UAH", "AED", "AUD", "COP", "MYR", "SGD", "NZD", "THB", "HUF", "HKD", "ZAR", "PHP", "KES", "EGP", "PKR", "PLN", "XAU", "VND", "GBX",
)
MONEY_BEFORE = r"((?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, CURRENCY_CODES + CURRENCY_SYMBOLS)) + r")\s*)$"
MONEY_AFTER = r"^(\s*(?:million|billion|mln|bln|bn|thousand)\b\.?)"
MONTH = r"^(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\b"
#: How much text beside a mention the corrections may look at: the longest of them needs a few words.
BESIDE = 48


def corrected(mentions: DataFrame, documents: DataFrame, countries: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
    """A general tagger's mentions with this project's types and mended borders.

    ``mentions``: data_id, pos, start_offset, end_offset, label; ``documents``: data_id, text.  A title before
    a person, the day before a month, a currency sign before and ``million`` after a number, and ``Kingdom
    of`` belong to the mention; a genitive ``'s``, a closing ``to`` or ``as`` and a leading article don't.
    Places named in ``countries`` are organisations unless ``in`` or ``from`` stands within two words before
    them.  Short bare numbers as dates, short numbers, list numbers at the start of a text, words in ``never``
    and labels that stand for nothing are dropped, as are mentions outside their text.  Slices of the text are cut before
    anything else, so no row keeps a whole text.
    """
    s, e, label = F.col("start_offset"), F.col("end_offset"), F.col("label")
    cut = mentions.select("data_id", "pos", "start_offset", "end_offset", "label").join(documents.select("data_id", "text"), "data_id").select(
        "data_id", "pos", s, e, label, F.substring("text", s + 1, e - s).alias("span"),
        F.substring("text", F.greatest(s - BESIDE, F.lit(0)) + 1, F.least(s, F.lit(BESIDE))).alias("before"), F.substring("text", e + 1, F.lit(BESIDE)).alias("after"),
    )
    span, before, after = F.col("span"), F.col("before"), F.col("after")
    size = lambda c, p, *g: sum((F.length(F.regexp_extract(c, p, i)) for i in g[1:]), F.length(F.regexp_extract(c, p, g[0])))
    money, number, day = label.isin("MONEY"), label.isin("MONEY", "CARDINAL"), label.isin("DATE", "TIME")
    realm, priced = before.rlike(REALM), before.rlike(MONEY_BEFORE) & (number | label.isin("QUANTITY", "PERCENT"))
    dated = label.isin("DATE") & before.rlike(r"(?:^|\s)\d\d?\s+$") & span.rlike(MONTH)
    left = (
        F.when(label == "PERSON", size(before, TITLE, 1, 2)).when(realm, size(before, REALM, 1)).when(priced, size(before, MONEY_BEFORE, 1)).when(dated, size(before, r"(\d\d?\s+)$", 1)).otherwise(0)
    )
    article = F.when(left == 0, size(span, r"(?i)^((?:the|a)\s+)\S", 1)).otherwise(0)
    tail = F.when(span.rlike(r"\S\s+(?:to|as)$"), size(span, r"(\s+(?:to|as))$", 1)).when((label == "PERSON") & span.rlike(r".'s$"), 2).otherwise(0)
    more = F.when(number & after.rlike(MONEY_AFTER), size(after, MONEY_AFTER, 1)).otherwise(0)
    home = span.rlike("Kingdom of|Republic of") | realm
    named = F.coalesce(span.isin(*countries), F.lit(False)) & ~before.rlike(r"(?:^|\s)(?:in|from)\s+(?:\S+\s+)?$") if countries else F.lit(False)
    kinds = F.create_map(*(F.lit(x) for p in TAGGER_TYPES.items() for x in p))
    kind = F.when(realm | ((label == "GPE") & (home | named)), "ORG").when(priced | money | (number & after.rlike(MONEY_AFTER)) | span.rlike(r"^\d\S*p$"), "QUANTITY").otherwise(kinds[label])
    listed = (s == 0) & F.concat(span, after).rlike(r"^(?:\d+\.(?:\s|$)|[A-Z]\.(?:\s|$)|(?:II|III|IV|VI|VII|VIII|IX)\.)")
    bare = (day & span.rlike(r"^\d{1,3}$")) | ((kind == "CODE") & ((F.length("span") <= 4) | ~span.rlike(r"\d")))
    live = cut.where("length(span) = end_offset - start_offset and end_offset > start_offset").where(~listed)
    live = live.where(~span.isin(*never)) if never else live
    return live.select("data_id", "pos", (s - left + article).cast("int").alias("start_offset"), (e - tail + more).cast("int").alias("end_offset"), kind.alias("entity_type"), bare.alias("_bare")).where("entity_type is not null and not _bare").drop("_bare")
