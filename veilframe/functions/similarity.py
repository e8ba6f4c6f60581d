"""Similarities that no built-in expresses, as Arrow-batched Pandas UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions kept and the prefix bonus always applied."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = list(range(len(b)))
    left, used = [], []
    for i, ch in enumerate(a):
        hit = next((j for j in free if i - reach <= j <= i + reach and b[j] == ch), None)
        if hit is not None:
            free.remove(hit)
            left.append(ch)
            used.append(hit)
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(left, sorted(used)))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3.0
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if None in pair else jaro_winkler(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


# --- BLEU with smoothing of orders without a hit ------------------------------


def bleu(reference: str, candidate: str, orders: int = 4, k: float = 5.0) -> float:
    """Sentence BLEU of white-space tokens against one reference.

    An order without a hit counts 1 / (2**i * k / ln(length)) hits, i being the
    number of such orders so far; without any equal word the score is 0.
    """
    ref, hyp = reference.split(), candidate.split()
    if not hyp:
        return 0.0
    logs, missing = 0.0, 0
    for n in range(1, orders + 1):
        have = Counter(zip(*(hyp[i:] for i in range(n))))
        want = Counter(zip(*(ref[i:] for i in range(n))))
        hits, total = sum(min(c, want[g]) for g, c in have.items()), max(1, sum(have.values()))
        if n == 1 and not hits:
            return 0.0
        if not hits:
            if len(hyp) < 2:
                return 0.0
            missing += 1
            hits = 1 / (2**missing * k / math.log(len(hyp)))
        logs += math.log(hits / total) / orders
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(logs)


@F.pandas_udf(T.DoubleType())
def bleu_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([bleu(x or "", y or "") for x, y in zip(reference, candidate)], dtype="float64")


# --- Stemming (Porter's published algorithm) ----------------------------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = re.compile(f"^({_C})?{_V}{_C}"), re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_M2, _HAS_V = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}"), re.compile(f"^({_C})?[aeiouy]")
_DOUBLE, _CVC = re.compile(r"([^aeiouylsz])\1$"), re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
#: Suffixes of steps 2 to 4 and what they become (fixed values).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings):
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M0.match(w[:-3]) else w
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and _HAS_V.match(cut):
            w = cut + "e" if cut.endswith(("at", "bl", "iz")) or (_M1.match(cut) and _CVC.match(cut)) else cut[:-1] if _DOUBLE.search(cut) else cut
    if w.endswith("y") and _HAS_V.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, table)
        if end and _M0.match(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = _longest(w, (*_STEP4, "ion"))
    if end and _M2.match(w[: -len(end)]) and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        cut = w[:-1]
        if _M2.match(cut) or (_M1.match(cut) and not _CVC.match(cut)) or (_M0.match(cut) and not _M1.match(cut)):
            w = cut
    if w.endswith("ll") and _M2.match(w[:-1]):
        w = w[:-1]
    return w


def overlap_tokens(text: str) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in re.sub(r"[^a-z0-9]+", " ", text.lower()).split()]


# --- ROUGE ---------------------------------------------------------------------


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _lcs_places(a: list, b: list, every: int = 128) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``.

    A row is one integer, with a bit of 0 where ``b``'s prefix gains a word.
    One row in ``every`` is kept; those between are made again when the way
    back comes to them, so memory grows with the texts, not with their product.
    """
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1

    def below(row: int, x) -> int:
        hit = row & where.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    row, kept = full, [full]
    for i, x in enumerate(a, 1):
        row = below(row, x)
        if i % every == 0:
            kept.append(row)
    i, j, left, out = len(a), len(b), len(b) - row.bit_count(), set()
    first, rows = len(a) + 1, []
    while left:
        if i - 1 < first:
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for x in a[first:i]:
                rows.append(below(rows[-1], x))
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j, left = i - 1, j - 1, left - 1
        elif not rows[i - first] >> (j - 1) & 1 or j - (rows[i - 1 - first] & ((1 << j) - 1)).bit_count() == left:
            i -= 1
        else:
            j -= 1
    return out


def f1(hits: float, candidate: int, reference: int) -> float:
    p, r = hits / max(candidate, 1), hits / max(reference, 1)
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge(reference: str, candidate: str) -> dict[str, float]:
    """F1 of ROUGE-1, ROUGE-L and ROUGE-Lsum, stemmed."""
    a, b = overlap_tokens(reference), overlap_tokens(candidate)
    want, have = Counter(a), Counter(b)
    one = f1(sum((want & have).values()), len(b), len(a))
    lines = f1(lcs_length(a, b), len(b), len(a))
    ref_lines = [t for t in map(overlap_tokens, reference.split("\n")) if t]
    cand_lines = [t for t in map(overlap_tokens, candidate.split("\n")) if t]
    left, right, hits = Counter(t for x in ref_lines for t in x), Counter(t for x in cand_lines for t in x), 0
    for x in ref_lines:
        for i in sorted(set().union(*(_lcs_places(x, y) for y in cand_lines)) if cand_lines else ()):
            if left[x[i]] > 0 and right[x[i]] > 0:
                hits += 1
                left[x[i]] -= 1
                right[x[i]] -= 1
    return {"rouge1": one, "rougeL": lines, "rougeLsum": f1(hits, sum(map(len, cand_lines)), sum(map(len, ref_lines)))}


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("rouge1", "rougeL", "rougeLsum")]))
def rouge_udf(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rouge(x or "", y or "") for x, y in zip(reference, candidate)], columns=["rouge1", "rougeL", "rougeLsum"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    def score(x: str, y: str) -> float:
        a, b = overlap_tokens(x), overlap_tokens(y)
        return f1(lcs_length(a, b), len(b), len(a))

    return pd.Series([score(x or "", y or "") for x, y in zip(reference, candidate)], dtype="float64")


def rouge1_f1(reference, candidate):
    """ROUGE-1 F1 of unstemmed lower-cased word tokens, as a Column expression."""
    a, b = (F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "") for c in (reference, candidate))
    kinds = F.array_distinct(F.array_intersect(a, b))
    hits = F.aggregate(kinds, F.lit(0), lambda acc, k: acc + F.least(F.size(F.filter(a, lambda t: t == k)), F.size(F.filter(b, lambda t: t == k))))
    return F.when(hits > 0, 2.0 * hits / (F.size(a) + F.size(b))).otherwise(0.0)
