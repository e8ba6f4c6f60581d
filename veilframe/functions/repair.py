"""Repair and reading of JSON-like model answers, where order of repairs matters.

These run in Arrow-batched Pandas UDFs, and only for answers that Spark's own
JSON reader rejects.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.IntegerType()),
            T.StructField("description", T.StringType()),
            T.StructField("PIIs", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("certainty", T.IntegerType()), T.StructField("hardness", T.IntegerType())]))),
        ]
    )
)
OUTCOME = T.StructType([T.StructField("status", T.StringType()), T.StructField("subjects", PROFILE), T.StructField("error", T.StringType())])

#: Regex repairs in the order in which they have to run (fixed values).
REPAIRS = (
    (r"(?m)^\s*//[^\n]*(\n|$)", ""),
    (r",\s*//[^\n]*", ""),
    (r"```(json)?", ""),
    ("，", ","),
    (r"'(\w+)\":", r'"\1":'),
    (r"'(\w+)':", r'"\1":'),
    (r"\"(\w+)':", r'"\1":'),
    (r'([,{]\s*)(\w+)":', r'\1"\2":'),
    (r'"\s+(\w+)\s+":', r'"\1":'),
    (r'"\.(\w+)":', r'"\1":'),
    (r"\{'", '{"'),
    (r"'\}", '"}'),
    (r"'\s*:", '":'),
    (r":\s*'", ':"'),
    (r",\s*'", ',"'),
    (r"'\s*,", '",'),
    (r"\}\s*\{", "},{"),
    (r"\]}'", "]}"),
    (r"\(\{", "{"),
    (r"\}\)", "}"),
    (r",\s*\]", "]"),
    (r",\s*\}", "}"),
)
_COMPILED = tuple((re.compile(p), r) for p, r in REPAIRS)


def fix_json(text: str) -> str:
    """A likely repair of broken JSON; brackets left open are closed at the end."""
    for pattern, new in _COMPILED:
        text = pattern.sub(new, text)
    return text + "]" * max(0, text.count("[") - text.count("]")) + "}" * max(0, text.count("{") - text.count("}"))


#: The second pass: replacements in the order in which they have to run (fixed values).
CLEANINGS = (
    ("\n    ", ""), ("\n ", ""), ("\n", ""), ("  ", " "), ("  ", " "), ("**", ""), (" ... ", " "), ("[...", "["), ("...]", "]"), ("...", ""),
    ("\\'s", "'s"), ('"s', "'s"), ("`", ""), ("\\", ""),
)
#: What stands between two people in a broken list, in order; each becomes ``JOINED`` (fixed values).
SEAMS = (
    '}]}], [{"id"',
    '}]}], {"id"',
    '}]}],[{"id"',
    '}]}][{"id"',
    '}]}]{"id"',
    '}]}]}, {"id"',
    '}]], [{"id"',
    '}]], {"id"',
    '}]],[{"id"',
    '}]][{"id"',
    '}]],{"id"',
    '}}], [{"id"',
    '}}], {"id"',
    '}}],[{"id"',
    '}}][{"id"',
    '}}]),{"id"',
    '}}],{"id"',
    '}}, [{"id"',
    '}}, {"id"',
    '}},[{"id"',
    '}}[{"id"',
    '}},{"id"',
    '}], [{"id"',
    '}], {"id"',
    '}],[{"id"',
    '}][{"id"',
    '}],{"id"',
    '}]},{["id"',
    '}]},{{"id"',
    '}],{["id"',
    '}],{{"id"',
)
JOINED = '}]}, {"id"'
#: Misplaced brackets and quotes (fixed values, in order).
MISPLACED = (
    ('"hardness}', '"hardness"'),
    ("}:", '}"'),
    (", {}", ""),
    ("{}", ""),
    ('{tag:"', '{"tag":"'),
    ('"tag:"', '"tag":"'),
    ('"keyword:"', '"keyword":"'),
    ('"},', "},"),
)
EDGES = "[]{} \n,\t"


def clean_json(text: str | None) -> str:
    """A stronger repair: separators between people put right, everything but one list of people with lists of values cut off."""
    if not text:
        return ""
    text = fix_json(text)
    for old, new in CLEANINGS:
        text = text.replace(old, new)
    for seam in SEAMS:
        text = text.replace(seam, JOINED)
    for old, new in MISPLACED:
        text = text.replace(old, new)
    inside = text.strip(EDGES)
    if inside:
        text = "[{" + inside + "}]}]"
    try:
        json.loads(text)
    except ValueError:
        text = re.sub(r"(?m)^```(?:json)?\s*", "", text)
        text = re.sub(r"(?m)```\s*$", "", text)
    return text


def _read(text: str):
    for source in (text, fix_json(text), clean_json(text)):
        for reader in (json.loads, ast.literal_eval):
            try:
                got = reader(source)
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                continue
            if isinstance(got, (list, dict)):
                return got
    return None


def _whole(value, default: int = 0) -> int:
    try:
        return int(str(value).strip())
    except ValueError:
        return default


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _piis(raw) -> list[tuple]:
    if isinstance(raw, dict):
        raw = [{"tag": t, **v} for t, v in raw.items() if isinstance(v, dict)]
    if not isinstance(raw, list):
        return []
    return [(p.get("tag"), _text(p.get("keyword", p.get("value"))), _whole(p.get("certainty")), _whole(p.get("hardness"), 1)) for p in raw if isinstance(p, dict)]


_PERSON = re.compile(r"\*\*\s*Person\s+(\d+)\s*:?\s*\*\*:?(.*?)(?=\*\*\s*Person\s+\d+|\Z)", re.S | re.I)
_FIELD = re.compile(r"^\W*([A-Z][A-Z_ ]+)\W*[:=]\s*(.+?)\s*$", re.M)


def _sections(answer: str) -> list[tuple]:
    """People from headed sections of plain text: ``TAG: value (certainty n)`` lines."""
    parts = _PERSON.findall(answer) or [(str(i), p) for i, p in enumerate(x for x in answer.split("---") if _FIELD.search(x))]
    out = []
    for number, body in parts:
        piis = []
        for tag, value in _FIELD.findall(body):
            sure = re.search(r"certainty\s*[:=]?\s*(\d)", value, re.I)
            piis.append((tag.strip().replace(" ", "_"), re.sub(r"\s*[(\[]?\s*certainty\s*[:=]?\s*\d\s*[)\]]?", "", value, flags=re.I).strip(), int(sure[1]) if sure else 0, 1))
        if piis:
            out.append((_whole(number), "", piis))
    return out


def read_profiles(answer: str | None) -> tuple:
    """(status, subjects, error): JSON, repaired JSON, a Python literal, or headed sections."""
    if not answer or not answer.strip():
        return "error", None, "empty answer"
    start = min((i for i in (answer.find("["), answer.find("{")) if i >= 0), default=-1)
    end = max(answer.rfind("]"), answer.rfind("}"))
    body = answer[start : end + 1] if 0 <= start < end else answer
    got = _read(body) if start >= 0 else None
    if isinstance(got, dict):
        got = got.get("subjects", [got]) if isinstance(got.get("subjects", [got]), list) else [got]
    if isinstance(got, list):
        people = [(_whole(x.get("id")), _text(x.get("description")), _piis(x.get("PIIs"))) for x in got if isinstance(x, dict)]
        if people:
            return "success", people, None
    people = _sections(answer)
    return ("success", people, None) if people else ("error", None, "no subjects in answer")


@F.pandas_udf(OUTCOME)
def _profiles_udf(answers: pd.Series) -> pd.DataFrame:
    rows = []
    for a in answers:
        status, people, error = read_profiles(a)
        subjects = None if people is None else [{"id": i, "description": d, "PIIs": [dict(zip(("tag", "keyword", "certainty", "hardness"), p)) for p in piis]} for i, d, piis in people]
        rows.append((status, subjects, error))
    return pd.DataFrame(rows, columns=["status", "subjects", "error"])


@F.pandas_udf(T.StringType())
def fix_json_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else fix_json(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def clean_json_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else clean_json(t) for t in texts], dtype=object)


STRICT = "array<struct<id:int,description:string,PIIs:array<struct<tag:string,keyword:string,certainty:int,hardness:int>>>>"


def strict_profiles(answer: Column) -> Column:
    """The subjects of an answer that is valid JSON already, else null; stays in the JVM."""
    return F.from_json(answer, STRICT, {"mode": "PERMISSIVE"})


def parse_profiles(df, answer: str = "response"):
    """Adds ``parsed`` (status, subjects, error); only answers that aren't clean JSON reach Python.

    The rows of ``df`` are read once: one select, no union of parts of it.
    """
    strict = strict_profiles(F.col(answer))
    clean = F.coalesce(strict.isNotNull() & (F.size(strict) > 0) & F.forall(strict, lambda s: s["id"].isNotNull() & s["PIIs"].isNotNull()), F.lit(False))
    read = df.withColumn("_strict", F.when(clean, strict))
    mended = _profiles_udf(F.when(F.col("_strict").isNull(), F.col(answer)))
    good = F.struct(F.lit("success").alias("status"), F.col("_strict").alias("subjects"), F.lit(None).cast("string").alias("error"))
    return read.withColumn("parsed", F.when(F.col("_strict").isNotNull(), good).otherwise(mended)).drop("_strict")


# --- Inferences of an attacker ----------------------------------------------------

INFERENCE = T.MapType(T.StringType(), T.StructType([T.StructField("inference", T.StringType()), T.StructField("guess", T.ArrayType(T.StringType())), T.StructField("certainty", T.StringType())]))
#: What an attribute without an answer gets (fixed values).
MISSING = {"inference": "MISSING", "guess": [], "certainty": "1"}


def closest_attribute(value: str, attributes) -> str:
    v = value.lower().strip()
    exact = [a for a in attributes if a.lower() == v]
    near = [a for a in attributes if v in a.lower() or a.lower() in v]
    return (exact or near or [value])[0]


def read_inferences(answer: str, attributes) -> dict:
    """Type / Inference / Guess / Certainty lines by attribute; a line without a colon continues its field."""
    found: dict[str, dict] = {}
    here, field = None, None
    for line in filter(None, map(str.strip, answer.split("\n"))):
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not value:
            if here is not None and field:
                old = found[here].get(field)
                text = line.rstrip(":")
                found[here][field] = [*old, text] if isinstance(old, list) else f"{old}\n{text}"
        elif name == "type":
            here, field = closest_attribute(value, attributes), None
            found.setdefault(here, {})
        elif name in ("inference", "guess", "certainty") and here is not None:
            field = name
            found[here][name] = [g.strip() for g in value.split(";") if g.strip()] if name == "guess" else value
    return found | {a: dict(MISSING) for a in attributes if a not in found}


def inferences_udf(attributes: tuple[str, ...]):
    @F.pandas_udf(T.StringType())
    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(read_inferences(a or "", attributes), ensure_ascii=False, sort_keys=True) for a in answers], dtype=object)

    return run


def inferences(answer: Column, attributes: tuple[str, ...]) -> Column:
    """map<attribute,struct<inference,guess,certainty>> of an attacker's answer."""
    return F.from_json(inferences_udf(attributes)(answer), INFERENCE)
