"""Text expressions: trimming, words, offsets, masking.  All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script, as Java's and RE2's engines agree on them.
WORD = r"[\p{L}\p{N}_]+"
#: Characters and tokens that may stay uncovered in a masked mention (fixed values).
IGNORABLE_CHARS = " ,.-;:/&()[]–'\""
IGNORABLE_TOKENS = ("mr", "mrs", "ms", "no", "nr", "about")
#: Closed-class English words that stand in for the ignorable parts of speech where no tags are given.
CLOSED_CLASS = ("a", "an", "the", "this", "that", "of", "in", "on", "at", "by", "for", "from", "to", "with", "and", "or", "but", "nor", "not")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def plain(c: Column) -> Column:
    return F.lower(strip(c))


def replace_all(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(numbers: Column) -> Column:
    """For each element of an array the sum of those before it.

    Blocks of 64 are added up first, and blocks of blocks, so the work grows
    about in proportion to the array.
    """
    zero = F.lit(0).cast("long")

    def total(x):
        return F.aggregate(x, zero, lambda acc, e: acc + e)

    def level(x, depth):
        if not depth:
            return F.transform(x, lambda _, i: total(F.slice(x, 1, i)))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int")), lambda b: F.slice(x, b * 64 + 1, F.lit(64)))
        blocks = F.when(F.size(x) > 0, blocks).otherwise(F.array(x))
        inside = lambda start: lambda block, b: F.transform(block, lambda _, i: start[b] + total(F.slice(block, 1, i)))
        return let(blocks, lambda bl: let(level(F.transform(bl, total), depth - 1), lambda start: F.flatten(F.transform(bl, inside(start)))))

    return let(F.transform(numbers, lambda e: e.cast("long")), lambda x: level(x, 2))


def places(text: Column, pattern: Column, size) -> Column:
    """array<struct<h,s,e>>: each match, what ``size`` says of the text before it, and that with the match."""
    kind = "array<struct<h:string,s:bigint,e:bigint>>"

    def found(hits):
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: size(g).cast("long"))
        lengths = F.transform(hits, lambda h: size(h).cast("long"))
        both = lambda g, n: let(sums_before(F.zip_with(g, n, lambda a, b: a + b)), lambda at: F.transform(hits, lambda h, i: F.struct(h.alias("h"), (at[i] + g[i]).alias("s"), (at[i] + g[i] + n[i]).alias("e"))))
        return let(gaps, lambda g: let(lengths, lambda n: both(g, n)))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(found(hits)))


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<span_text,start_offset,end_offset>> of all matches, in code points.

    Offsets come from the lengths of the gaps and matches before; Spark's own
    position functions of regexes count UTF-16 units.
    """
    return F.transform(places(text, F.lit(pattern), F.length), lambda p: F.struct(p["h"].alias("span_text"), p["s"].cast("int").alias("start_offset"), p["e"].cast("int").alias("end_offset")))


def tokens(text: Column, start: Column, end: Column) -> Column:
    """Word tokens of ``text[start:end]`` with absolute offsets."""
    inside = pieces(F.substring(text, start + 1, end - start), WORD)
    return F.transform(inside, lambda t: F.struct(t["span_text"].alias("token"), (t["start_offset"] + start).alias("start_offset"), (t["end_offset"] + start).alias("end_offset")))


def merged(spans: Column) -> Column:
    """Sorted, disjoint array<struct<s,e>> with the coverage of the given intervals."""
    kind = "array<struct<s:int,e:int>>"
    ordered = F.array_sort(F.filter(spans.cast(kind), lambda x: x["e"] > x["s"]))

    def add(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] <= last["e"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, x))

    return F.aggregate(ordered, F.array().cast(kind), add)


def uncovered(text: Column, start: Column, end: Column, masked: Column) -> Column:
    """The pieces of ``text[start:end]`` that no interval of ``masked`` (merged) covers."""
    inside = F.filter(masked, lambda m: (m["s"] < end) & (m["e"] > start))
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, m):
        gap = F.substring(text, acc["at"] + 1, m["s"] - acc["at"])
        out = F.when(m["s"] > acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], m["e"]).cast("int").alias("at"), out.alias("out"))

    def rest(acc):
        return F.when(acc["at"] < end, F.array_append(acc["out"], F.substring(text, acc["at"] + 1, end - acc["at"]))).otherwise(acc["out"])

    return F.aggregate(inside, zero, step, rest)


def ignorable(piece: Column, extra: tuple[str, ...] = CLOSED_CLASS) -> Column:
    """Whether a piece holds nothing but ignorable tokens and characters.

    ``Mr.`` counts as the token ``mr`` and a full stop: words are split from
    punctuation here, so titles are ignorable with or without their stop.
    """
    words = "|".join((*IGNORABLE_TOKENS, *extra))
    without = F.regexp_replace(F.lower(piece), rf"(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])", "")
    return F.translate(without, IGNORABLE_CHARS, "") == ""


def mention_masked(text: Column, start: Column, end: Column, masked: Column) -> Column:
    return F.forall(uncovered(text, start, end, masked), lambda piece: ignorable(piece))


def apply_masks(text: Column, spans: Column) -> Column:
    """``text`` with each span (struct<start_offset,end_offset,entity_type>) replaced by ``[TYPE]``, from the end on."""
    backwards = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start_offset"].alias("s"), s["end_offset"].alias("e"), s["entity_type"].alias("t")))))
    return F.aggregate(backwards, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["s"]), F.lit("["), s["t"], F.lit("]"), F.substring(acc, s["e"] + 1, F.length(acc))))


def length_check(original: Column, anonymized: Column, threshold: float = 0.4) -> Column:
    """struct<length_diff,length_ratio,length_anomaly>; an empty original has ratio 0 or infinity."""
    o, a = F.length(original), F.length(anonymized)
    ratio = F.when(o > 0, a / o).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.struct(F.abs(a - o).alias("length_diff"), F.round(ratio, 3).alias("length_ratio"), (F.abs(ratio - 1) > threshold).alias("length_anomaly"))


# --- Offsets ----------------------------------------------------------------------

#: Code points of a block of a text.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points, cut in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def block_slice(parts: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` from its blocks; a negative start counts as 0, and offsets behind the text give what there is."""
    a = F.greatest(start, F.lit(0))
    first = F.floor(a / BLOCK).cast("int")
    n = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(1))
    return F.substring(F.array_join(F.slice(parts, first + 1, n), ""), (a - first * BLOCK).cast("int") + 1, F.greatest(end - a, F.lit(0)).cast("int"))


def offset_directory(text: Column) -> Column:
    """struct<blocks,bytes,units>: a text's blocks, and the UTF-8 bytes and UTF-16 units before each of them.

    Made once a text, as a column of its own; a conversion then looks at one block.
    """
    units = lambda b: (F.octet_length(F.encode(b, "UTF-16BE")) / 2).cast("long")
    sized = lambda b, size: sums_before(F.concat(F.transform(b, lambda x: size(x).cast("long")), F.array(F.lit(0).cast("long"))))
    return let(blocks(text), lambda b: F.struct(b.alias("blocks"), sized(b, F.octet_length).alias("bytes"), sized(b, units).alias("units")))


def _length(d: Column) -> Column:
    n = F.size(d["blocks"])
    return F.when(n == 0, F.lit(0)).otherwise((n - 1) * BLOCK + F.length(d["blocks"][n - 1]))


def _from_chars(d: Column, at: Column, before: str, size) -> Column:
    i = F.least(F.greatest(at, F.lit(0)), _length(d))
    b = F.floor(i / BLOCK).cast("int")
    rest = F.coalesce(F.get(d["blocks"], b), F.lit(""))
    return (d[before][b] + size(F.substring(rest, F.lit(1), (i - b * BLOCK).cast("int")))).cast("int")


def _block_of(starts: Column, at: Column) -> Column:
    """The last block that begins at or before an offset, by bisection."""
    zero = F.struct(F.lit(0).alias("lo"), (F.size(starts) - 1).alias("hi"))
    mid = lambda x: F.ceil((x["lo"] + x["hi"]) / 2).cast("int")
    halve = lambda x, _: F.when(starts[mid(x)] <= at, F.struct(mid(x).alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct(x["lo"].alias("lo"), F.greatest(mid(x) - 1, x["lo"]).alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + F.lit(1))).cast("int") + 1), zero, halve)["lo"]


def _to_chars(d: Column, at: Column, before: str, encoding: str, width: int) -> Column:
    """Code points before an offset; one outside the text or inside a character gives the text's length."""
    whole = _length(d)

    def inside(b):
        code = F.encode(F.coalesce(F.get(d["blocks"], b), F.lit("")), encoding)
        head = F.substring(code, F.lit(1), ((at - d[before][b]) * width).cast("int"))
        # a head that ends inside a character isn't what its own text would be written as
        text = F.try_validate_utf8(head.cast("string")) if encoding == "UTF-8" else F.decode(F.when(_ends_whole(head), head), encoding)
        return F.when(text.isNotNull(), F.least(b * BLOCK + F.length(text), whole)).otherwise(whole)

    fits = (at >= 0) & (at <= F.element_at(d[before], -1))
    return F.when(fits, let(_block_of(d[before], at), inside)).otherwise(whole).cast("int")


def _ends_whole(head: Column) -> Column:
    """Whether UTF-16 (big end first) doesn't end behind the first half of a pair."""
    unit = F.conv(F.hex(F.substring(head, -2, 2)), 16, 10).cast("int")
    return (F.octet_length(head) == 0) | ~unit.between(0xD800, 0xDBFF)


def _units(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def byte_of_char(d: Column, at: Column) -> Column:
    """UTF-8 bytes before a code point; offsets behind the text give its size, negative ones 0."""
    return _from_chars(d, at, "bytes", F.octet_length)


def unit_of_char(d: Column, at: Column) -> Column:
    """UTF-16 units before a code point."""
    return _from_chars(d, at, "units", _units)


def char_of_byte(d: Column, at: Column) -> Column:
    return _to_chars(d, at, "bytes", "UTF-8", 1)


def char_of_unit(d: Column, at: Column) -> Column:
    return _to_chars(d, at, "units", "UTF-16BE", 2)


def unit_of_byte(d: Column, at: Column) -> Column:
    return unit_of_char(d, char_of_byte(d, at))


def byte_of_unit(d: Column, at: Column) -> Column:
    return byte_of_char(d, char_of_unit(d, at))


def slice_of_bytes(d: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return block_slice(d["blocks"], char_of_byte(d, start), char_of_byte(d, end))


def slice_of_units(d: Column, start: Column, end: Column) -> Column:
    """The text between two offsets in UTF-16 units."""
    return block_slice(d["blocks"], char_of_unit(d, start), char_of_unit(d, end))


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 bytes before a code point; for many offsets of a text make its ``offset_directory``."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def utf16_offset(text: Column, chars: Column) -> Column:
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), chars), "UTF-16LE")) / 2).cast("int")


def char_offset_of_bytes(text: Column, offset: Column) -> Column:
    """Code points before a byte offset; an offset inside a character gives the text's length."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset)
    good = F.is_valid_utf8(head.cast("string")) & (offset <= F.octet_length(text))
    return F.when(good, F.length(head.cast("string"))).otherwise(F.length(text))


def char_offset_of_utf16(text: Column, offset: Column) -> Column:
    """Code points before an offset in UTF-16 units; one inside a surrogate pair gives the text's length."""
    points = F.filter(F.split(text, ""), lambda ch: ch != "")
    sizes = F.transform(points, lambda ch: F.when(F.octet_length(ch) == 4, 2).otherwise(1))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("units"))
    walked = F.aggregate(sizes, zero, lambda acc, s: F.when(acc["units"] < offset, F.struct((acc["n"] + 1).alias("n"), (acc["units"] + s).alias("units"))).otherwise(acc))
    return F.when(walked["units"] == offset, walked["n"]).otherwise(F.length(text))


#: Code-point ranges that count as emoji (fixed values).
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{FE00}-\\x{FE0F}\\x{1F900}-\\x{1F9FF}\\x{1F018}-\\x{1F270}]"


def is_emoji(ch: Column) -> Column:
    return ch.rlike(f"^{EMOJI}")
