"""Registered queries of the tagger of personal data, trained on what the documents' planted data looks like."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.text import pieces
from veilframe.operators import tagger
from veilframe.plans import anonymize
from veilframe.queries import register, table

#: The personal data planted in the documents, by type.
PLANTED = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("SECRET", r"\b[0-9a-f]{40}\b"),
    ("CARD", r"\b[0-9]{16}\b"),
)


def planted(text):
    """The true mentions of a text."""
    of = lambda s: F.coalesce(*(F.when(s.rlike(f"^(?:{p})$"), k) for k, p in PLANTED))
    return F.transform(pieces(text, "|".join(p for _, p in PLANTED)), lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"), of(s["span_text"]).alias("entity_type")))


def documents(spark, sf_dir):
    """Documents with their true mentions; a model learns from those whose crc32 leaves another rest by 4 than 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    return docs.withColumn("mentions", planted(F.col("text")))


@register("tagger_spans")
def tagger_spans(spark, sf_dir):
    """Per document: the mentions there are, those that the tagger found, those found exactly, and what masking leaves of the text."""
    docs = documents(spark, sf_dir)
    model = tagger.fit(docs.where("not held_out"))
    found = tagger.found(docs, model)
    plain = F.transform("spans", lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"), s["entity_type"].alias("entity_type")))
    masked = anonymize.masked(F.col("text"), plain)
    return found.select("data_id", "held_out", F.size("mentions").alias("gold"), F.size("spans").alias("found"), F.size(F.array_intersect("mentions", plain)).alias("exact"), F.sha2(masked, 256).alias("masked_sha256"))
