"""Vectorised hashing of words and characters of many texts at once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

#: Odd 64-bit multipliers (fixed values), one for each place in an n-gram.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Characters that one vector step covers; longer texts go in several steps.
STEP_CHARS = 1 << 19
BLANK = re.compile(r"\s")


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts, overlap: int):
    """Lists of (document number, characters to skip, text piece) of about STEP_CHARS characters.

    A long text is cut into pieces, each after the first led by ``overlap``
    characters of the one before, which are to be skipped.
    """
    held, n = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), STEP_CHARS):
            lead = min(at, overlap)
            piece = text[at - lead : at + STEP_CHARS]
            if n and n + len(piece) > STEP_CHARS:
                yield held
                held, n = [], 0
            held.append((i, lead, piece))
            n += len(piece)
    if held:
        yield held


def slices(text: str):
    """The text in slices of about STEP_CHARS characters, cut before white space."""
    at = 0
    while at < len(text):
        m = BLANK.search(text, at + STEP_CHARS) if len(text) - at > STEP_CHARS else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def prior_shift(population: dict, sample: list[int]) -> float:
    """What a model's log-odds lack when classes were sampled at other rates than they occur."""
    n1, n0 = population.get(1, 0), population.get(0, 0)
    s1, s0 = sum(sample), len(sample) - sum(sample)
    if not (n1 and n0 and s1 and s0):
        return 0.0
    return float(np.log(n1 / n0) - np.log(s1 / s0))
