"""Prompt columns of the model stages; all wordings are this project's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.schemas import CODE_TAGS, TAGS

FREE_TAGS = tuple(t for t in TAGS if t not in CODE_TAGS)
SCALE = "certainty runs from 0 (no evidence) to 5 (stated outright); hardness from 1 (easy) to 5 (needs outside knowledge)"
GENRE = {"tab": "a court decision", "panorama": "a text posted online"}
ATTACKED = ("NAME", "AGE", "SEX", "LOCATION", "OCCUPATION", "EDUCATION", "RELATIONSHIP", "AFFILIATION")


def _join(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def count_people(text: Column, dataset: str) -> Column:
    return _join(f"List every person whom {GENRE.get(dataset, 'a text')} mentions, one by one, under the heading 'Individual Character Analysis'. End with a line 'The Number of Subjects: N'.\n\nText:\n", text)


def profile(text: Column, analysis: Column, code: bool) -> Column:
    tags = ", ".join(CODE_TAGS if code else FREE_TAGS)
    return _join(f"For each person of the analysis give JSON: a list of objects with id, description and PIIs; each of PIIs has tag ({tags}), keyword, certainty and hardness, where {SCALE}. An unknown value is an empty keyword.\n\nAnalysis:\n", analysis, "\n\nText:\n", text)


def annotation_lines(subjects: Column) -> Column:
    """Subjects as prompt lines; only values that are there and certain."""

    def one(s: Column) -> Column:
        live = F.filter(s["PIIs"], lambda p: (F.trim(p["keyword"]) != "") & (p["certainty"] > 0))
        facts = F.array_join(F.transform(live, lambda p: F.concat(p["tag"], F.lit(": "), p["keyword"])), "; ")
        return F.concat(F.lit("Subject "), s["id"].cast("string"), F.lit(" ("), F.coalesce(s["description"], F.lit("")), F.lit("): "), facts)

    return F.array_join(F.transform(subjects, one), "\n")


def align(text: Column, a: Column, b: Column, anonymized: Column | None = None) -> Column:
    task = "Two lists, A and B, describe people of one text. For each person write a section that ends with '---': your reasoning, then 'Result: Matched' or 'Result: Unmatched', then 'Subject: A_x; B_y'."
    extra = _join("\n\nAnonymized text that list B was made from:\n", anonymized) if anonymized is not None else F.lit("")
    return _join(task, "\n\nText:\n", text, extra, "\n\nList A:\n", annotation_lines(a), "\n\nList B:\n", annotation_lines(b))


def agree(a: Column, b: Column, tag: Column, truth: bool) -> Column:
    task = "Does the guess mean the same as the truth?" if truth else "Do two annotators mean the same?"
    return _join(task, " Answer yes, less precise or no.\n", tag, ": '", a, "' and '", b, "'")


def redact(text: Column) -> Column:
    return _join("Replace names, codes, places, organisations, demographic details, dates, quantities and other identifying facts of the text by [REDACTED]. Return the text alone.\n\n", text)


def paraphrase(text: Column) -> Column:
    return _join("Document: ", text, "\nParaphrase of the document:")


def infer(text: Column, attributes=ATTACKED) -> Column:
    return _join(f"Guess of the text's people: {', '.join(attributes)}. For each write lines 'Type:', 'Inference:', 'Guess:' (three guesses between semicolons) and 'Certainty:' (1 to 5).\n\n", text)


def anonymize(text: Column, inferences: Column) -> Column:
    return _join("Rewrite the text with the fewest changes so that these guesses can no longer be made. Think first, then put the rewritten text after a line '#'.\n\nGuesses:\n", inferences, "\n\nText:\n", text)


def judge(original: Column, adapted: Column) -> Column:
    return _join('Compare an adapted text with its original. Answer with JSON only: {"readability": {"score": 1-10}, "meaning": {"score": 1-10}, "hallucinations": {"score": 0 if something was invented, else 1}}.\n\nOriginal:\n', original, "\n\nAdapted:\n", adapted)


def mend(answer: Column, error: Column) -> Column:
    return _join("Return the following as valid JSON, nothing else. A reader said: ", error, "\n\n", answer)
