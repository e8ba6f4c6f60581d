"""From token labels to masked spans, and from spans to types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token starts a span only at this confidence (fixed value).
START = 0.55
#: Characters trimmed from both ends of a span (fixed value).
EDGE = r"['@.,;:!?\"()\[\]{}<>]+"


def label_spans(tokens: DataFrame, start: float = START) -> DataFrame:
    """Spans of runs of labelled tokens (data_id, pos, label, confidence, start_offset, end_offset).

    A run starts at a labelled token of enough confidence and goes on over
    labelled ones; a single unlabelled token of enough confidence between two
    labelled ones is bridged.  Tokens without offsets end a run.
    """
    w = Window.partitionBy("data_id").orderBy("pos")
    on = F.col("label") > 0
    real = F.col("start_offset").isNotNull() & F.col("end_offset").isNotNull()
    sure = F.col("confidence") >= start
    bridge = ~(on & real) & sure & F.coalesce(F.lag(on).over(w), F.lit(False)) & F.coalesce(F.lead(on).over(w), on)
    t = tokens.withColumn("_live", (on & real) | bridge).withColumn("_seed", on & real & sure)
    t = t.withColumn("_run", F.sum((~F.col("_live")).cast("int")).over(w)).where("_live")
    r = Window.partitionBy("data_id", "_run").orderBy("pos")
    t = t.withColumn("_begun", F.max(F.col("_seed").cast("int")).over(r)).where("_begun = 1")
    spans = t.groupBy("data_id", "_run").agg(F.min("pos").alias("pos"), F.min_by("start_offset", "pos").alias("start_offset"), F.max_by("end_offset", "pos").alias("end_offset"), F.max("confidence").alias("confidence"))
    return spans.drop("_run")


def bio_spans(tokens: DataFrame) -> DataFrame:
    """Spans of BIO tags (data_id, pos, bio, start_offset, end_offset): a B- or a break starts a new one."""
    w = Window.partitionBy("data_id").orderBy("pos")
    kind = F.regexp_replace("bio", "^[BI]-", "")
    before = F.lag("bio").over(w)
    fresh = (F.col("bio") != "O") & (F.col("bio").startswith("B-") | before.isNull() | (before == "O") | (F.regexp_replace(before, "^[BI]-", "") != kind))
    t = tokens.withColumn("_new", fresh.cast("int")).withColumn("label", kind).withColumn("_run", F.sum("_new").over(w)).where("bio <> 'O'")
    return t.groupBy("data_id", "_run").agg(F.first("label").alias("label"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset")).drop("_run").distinct()


def trim_span(text: Column, start: Column) -> Column:
    """struct<span_text,start_offset,end_offset> without blanks and edge characters at both ends."""
    left = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), "^" + EDGE, "")
    right = F.regexp_replace(F.regexp_replace(left, r"(?U)\s+$", ""), EDGE + "$", "")
    begin = start + F.length(text) - F.length(left)
    return F.struct(right.alias("span_text"), begin.alias("start_offset"), (begin + F.length(right)).alias("end_offset"))


def split_spans(spans: DataFrame) -> DataFrame:
    """Spans cut at the first ``|`` (else ``/``) into two, then trimmed; the last span of a document stays as it is."""
    last = F.row_number().over(Window.partitionBy("data_id").orderBy(F.desc("pos"))) == 1
    mark = F.when(F.contains("span_text", F.lit("|")), "|").when(F.contains("span_text", F.lit("/")), "/")
    parts = F.when(F.contains("span_text", F.lit("|")), F.split("span_text", "[|]")).otherwise(F.split("span_text", "/"))
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    halves = F.array(trim_span(one, F.col("start_offset")), trim_span(two, F.col("end_offset") - F.length(two)))
    whole = F.array(trim_span(F.col("span_text"), F.col("start_offset")))
    same = F.array(F.struct("span_text", "start_offset", "end_offset"))
    out = spans.withColumn("_last", last).withColumn("_parts", F.when(F.col("_last"), same).when(mark.isNotNull(), halves).otherwise(whole))
    return out.select("data_id", "pos", F.posexplode("_parts").alias("part", "s")).select("data_id", "pos", "part", "s.*")


def span_type(text: Column, model_label: Column | None = None) -> Column:
    """One of the eight types, from a model's label if it is of use, else from the span's look."""
    label = F.lit(None).cast("string") if model_label is None else model_label
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) > 2
    mail = F.contains(text, F.lit("@")) & F.contains(text, F.lit("."))
    dotted = F.contains(text, F.lit("-")) | F.contains(text, F.lit("."))
    look = F.when(capitals, "ORG").when(mail, "CODE").when(F.contains(text, F.lit(":")), "DATETIME").when(F.contains(text, F.lit("+")) | dotted, "CODE").otherwise("PERSON")
    state = F.contains(text, F.lit("Kingdom of")) | F.contains(text, F.lit("Republic of"))
    number = F.when(F.contains(text, F.lit(":")), "DATETIME").when(F.contains(text, F.lit("+")) | dotted, "CODE").when(capitals, "ORG").otherwise("CODE")
    told = (
        F.when(mail, "CODE")
        .when(label == "GPE", F.when(state, "ORG").otherwise("LOC"))
        .when(label.isin("LANGUAGE", "NORP"), "DEM")
        .when(label.isin("LOC", "FAC"), "LOC")
        .when(label.isin("DATE", "TIME"), "DATETIME")
        .when(label.isin("PERCENT", "QUANTITY", "MONEY"), "QUANTITY")
        .when(label == "CARDINAL", number)
        .otherwise(label)
    )
    useless = label.isNull() | label.isin("PRODUCT", "EVENT", "WORK_OF_ART", "MISC")
    return F.when(useless, look).otherwise(told)


def identifier_of(entity_type: Column) -> Column:
    return F.when(entity_type.isin("PERSON", "CODE"), "direct").otherwise("quasi")


def tab_entities(spans: DataFrame) -> DataFrame:
    """Numbered entities of a document's spans; empty ones and those that end at 0 go."""
    kept = spans.where("span_text <> '' and end_offset > 0")
    number = F.row_number().over(Window.partitionBy("data_id").orderBy("start_offset", "end_offset")).cast("string")
    kind = span_type(F.col("span_text"))
    return kept.withColumn("entity_type", kind).withColumn("identifier_type", identifier_of(F.col("entity_type"))).withColumn("span_id", number).withColumn("entity_id", number)


def training_labels(mentions: DataFrame) -> DataFrame:
    """Mentions with the label that training uses: MASK, or NO_MASK where the identifier type says so."""
    return mentions.withColumn("label", F.when(F.col("identifier_type") == "NO_MASK", "NO_MASK").otherwise("MASK"))


def bio_labels(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """BIO label of each token (data_id, pos, start_offset, end_offset) from labelled mentions.

    A token inside a mention gets that mention's label, B- at its first token;
    of overlapping mentions the first one by start counts.
    """
    m = training_labels(mentions).select(F.col("data_id").alias("m_id"), F.col("start_offset").alias("m_s"), F.col("end_offset").alias("m_e"), "label")
    inside = (tokens["data_id"] == F.col("m_id")) & (tokens["start_offset"] < F.col("m_e")) & (tokens["end_offset"] > F.col("m_s"))
    hit = tokens.join(m, inside, "left").groupBy("data_id", "pos", "start_offset", "end_offset").agg(F.min(F.struct("m_s", "m_e", "label")).alias("m"))
    first = F.row_number().over(Window.partitionBy("data_id", "m.m_s", "m.m_e").orderBy("pos")) == 1
    return hit.select("data_id", "pos", "start_offset", "end_offset", F.when(F.col("m.label").isNull(), "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), F.col("m.label"))).alias("bio"))


def windows(tokens: DataFrame, size: int, stride: int) -> DataFrame:
    """Overlapping token windows: rows (data_id, window, tokens) of at most ``size`` tokens, ``stride`` of them shared."""
    step = max(1, size - stride)
    whole = tokens.groupBy("data_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(step))
    return whole.select("data_id", F.posexplode(F.transform(starts, lambda s: F.slice("all", s + 1, F.lit(size)))).alias("window", "tokens"))
