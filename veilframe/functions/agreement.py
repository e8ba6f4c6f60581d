"""Rules that score how well two values of an attribute agree, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import plain, strip

IDENTIFIER_TAGS = ("IDENTIFICATION_NUMBER", "DRIVER_LICENSE_NUMBER", "PHONE_NUMBER", "PASSPORT_NUMBER")
CATEGORY_TAGS = ("SEX", "RELATIONSHIP", "EDUCATION")
#: Values of one group mean the same (fixed values).
SYNONYMS = {
    "SEX": (("male", "m", "man"), ("female", "f", "woman")),
    "RELATIONSHIP": (
        ("no relation", "single", "unmarried"),
        ("in relation", "dating", "relationship"),
        ("married", "wed"),
        ("divorced", "separated"),
        ("widowed", "widow", "widower"),
    ),
}
CLOSE = 0.85


def _levels(place: Column) -> Column:
    """The non-blank levels of a place, most general first."""
    return F.reverse(F.filter(F.transform(F.split(F.replace(plain(place), F.lit("turkey"), F.lit("türkiye")), "/"), strip), lambda x: x != ""))


def location_score(a: Column, b: Column, max_depth: int | None = None) -> Column:
    """1, 0.5 or 0 for places written ``specific / ... / general``.

    A place that the other one only makes more precise scores 0.5, whatever
    the depth.  Otherwise the most general ``max_depth`` levels count: all equal
    is 1, all but one 0.5 (so two different one-level places score 0.5 too).
    """
    la, lb = _levels(a), _levels(b)
    na, nb = F.size(la), F.size(lb)
    short, depth = F.least(na, nb), F.greatest(na, nb)
    if max_depth is not None and max_depth > 0:
        depth = F.least(depth, F.lit(max_depth))
    contained = (na != nb) & (short > 0) & (F.slice(la, F.lit(1), short) == F.slice(lb, F.lit(1), short))
    both = F.slice(F.zip_with(la, lb, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(1), depth)
    equal = F.size(F.filter(both, lambda x: x))
    same = F.replace(plain(a), F.lit("turkey"), F.lit("türkiye")) == F.replace(plain(b), F.lit("turkey"), F.lit("türkiye"))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(same, 1.0).when(contained, 0.5).when(equal == depth, 1.0).when(equal == depth - 1, 0.5).otherwise(0.0)


def age_outcome(a: Column, b: Column, overlap: float = 0.75, tolerance: int = 5) -> Column:
    """struct<match,error>: ranges by overlap, single ages by difference.

    An unreadable age beside a range is an error, which drops its whole subject
    from the metrics; two ages of which neither is a range nor both numbers
    simply don't match.
    """
    x, y = F.replace(strip(a), F.lit("–"), F.lit("-")), F.replace(strip(b), F.lit("–"), F.lit("-"))
    range_x, range_y = F.contains(x, F.lit("-")), F.contains(y, F.lit("-"))

    def part(v: Column, i: int) -> Column:
        return F.get(F.split(v, "-"), F.lit(i)).try_cast("int")

    lx, hx, ly, hy, vx, vy = part(x, 0), part(x, 1), part(y, 0), part(y, 1), x.try_cast("int"), y.try_cast("int")
    shared = F.greatest(F.lit(0), F.least(hx, hy) - F.greatest(lx, ly))
    width = F.greatest(F.least(hx - lx, hy - ly), F.lit(1))
    digits = x.rlike("^[0-9]+$") & y.rlike("^[0-9]+$")
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    match = (
        F.when(empty, False)
        .when(range_x & range_y, shared / width >= overlap)
        .when(digits, F.abs(vx - vy) <= tolerance)
        .when(range_x, (vy >= lx) & (vy <= hx))
        .when(range_y, (vx >= ly) & (vx <= hy))
        .otherwise(False)
    )
    bad_x, bad_y = lx.isNull() | hx.isNull(), ly.isNull() | hy.isNull()
    error = (
        F.when(empty, False)
        .when(range_x & range_y, bad_x | bad_y)
        .when(digits, False)
        .when(range_x, bad_x | vy.isNull())
        .when(range_y, bad_y | vx.isNull())
        .otherwise(False)
    )
    return F.struct(F.coalesce(match, F.lit(False)).alias("match"), F.coalesce(error, F.lit(False)).alias("error"))


def identifier_form(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def identifier_match(a: Column, b: Column) -> Column:
    """Equal without punctuation, or one ends with the other and is at most three characters longer."""
    x, y = identifier_form(a), identifier_form(b)
    tail = (F.endswith(x, y) | F.endswith(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 3)
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & ((x == y) | tail)


def synonym_group(c: Column, tag: str) -> Column:
    """The number of the synonym group of a value, null if it is in none."""
    pairs = [(F.lit(word), F.lit(i)) for i, group in enumerate(SYNONYMS.get(tag, ())) for word in group]
    return F.create_map(*chain.from_iterable(pairs))[plain(c)] if pairs else F.lit(None).cast("int")


def categorical_match(a: Column, b: Column, tag: Column) -> Column:
    same = plain(a) == plain(b)
    for name in SYNONYMS:
        same = same | ((tag == name) & F.coalesce(synonym_group(a, name) == synonym_group(b, name), F.lit(False)))
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & same


def needs_similarity(a: Column, b: Column, tag: Column) -> Column:
    """Whether only string similarity can decide: free text, both present, not equal."""
    ruled = (*IDENTIFIER_TAGS, *CATEGORY_TAGS, "AGE", "LOCATION", "EMAIL_ADDRESS")
    return F.coalesce((~tag.isin(*ruled)) & (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (plain(a) != plain(b)), F.lit(False))


def rule_outcome(a: Column, b: Column, tag: Column, similarity: Column, max_depth: int | None = None) -> Column:
    """struct<score,error> of two values of a tag; ``similarity`` is used where needs_similarity holds."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    age = age_outcome(x, y)
    score = (
        F.when((x == "") & (y == ""), 1.0)
        .when((x == "") | (y == ""), 0.0)
        .when(tag == "AGE", age["match"].cast("double"))
        .when(tag == "LOCATION", location_score(x, y, max_depth))
        .when(tag.isin(*CATEGORY_TAGS), categorical_match(x, y, tag).cast("double"))
        .when(tag.isin(*IDENTIFIER_TAGS), identifier_match(x, y).cast("double"))
        .when(tag == "EMAIL_ADDRESS", (plain(x) == plain(y)).cast("double"))
        .otherwise(((plain(x) == plain(y)) | F.coalesce(similarity >= CLOSE, F.lit(False))).cast("double"))
    )
    return F.struct(score.alias("score"), ((tag == "AGE") & age["error"]).alias("error"))
