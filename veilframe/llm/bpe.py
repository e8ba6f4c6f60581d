"""Byte-level BPE: vocabulary, plain encoding, decoding."""

from __future__ import annotations

import json
import re

import numpy as np

#: How byte-level BPE of this family splits a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern's engine knows it, and runs of it that are encoded apart from the pattern.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1 << 16
LONG_BLANKS = re.compile(f"(?<![{BLANKS}])[{BLANKS}]{{{LONG_RUN},}}")
#: What a vocabulary file has to say for the fast engine to give the library's ids.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(doc: dict) -> bool:
    """Whether a vocabulary file asks for nothing but plain byte-level BPE with ids in the order of merges."""
    model, split = doc.get("model", {}), doc.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    return (
        not doc.get("normalizer")
        and all(split.get(k) == v for k, v in PLAIN_SPLIT.items())
        and all(model.get(k, v) == v for k, v in PLAIN_MODEL.items())
        and all(t.get(k, v) == v for t in doc.get("added_tokens", []) for k, v in PLAIN_TOKEN.items())
        and set(byte_letters()) <= set(model["vocab"])
        and [model["vocab"].get("".join(m)) for m in merges] == list(range(256, 256 + len(merges)))
    )


class Splitter:
    """Cuts texts at special tokens, which stand for themselves."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def segments(self, text: str):
        """(segment, id): ordinary segments have id None, special tokens their id."""
        if self.split is None:
            yield text, None
            return
        for part in self.split.split(text):
            if part:
                yield part, self.special.get(part)


def special_tokens(doc: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in doc.get("added_tokens", [])}


class ByteBpe(Splitter):
    """Encodes as the vocabulary file's own library does, without added tokens.

    Where the file asks for nothing but plain byte-level BPE (``is_plain``),
    tiktoken's encoder runs on the same vocabulary, about four times as fast
    with equal ids (see the tests); otherwise the tokenizers library itself.
    Long runs of white space, which overflow the stack of that encoder's
    pattern, are merged as the one piece that they are: of a run that a visible
    character follows, the last blank belongs to what follows.
    """

    def __init__(self, spec: str):
        doc = json.loads(spec)
        letters = byte_letters()
        vocab = doc["model"]["vocab"]
        self.fast = is_plain(doc)
        super().__init__(special_tokens(doc) if self.fast else {})
        special = special_tokens(doc)
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(letters.get(ch, 63) for ch in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        #: How ids are stored.
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        if self.fast:
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in self.special}
            self._engine = tiktoken.Encoding("veilframe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(spec)
            self._library.no_padding()
            self._library.no_truncation()

    def plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        if not self.fast:
            return self._library.encode(text, add_special_tokens=False).ids
        if len(text) < LONG_RUN:
            return self._engine.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_BLANKS.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            if at < m.start():
                out += self._engine.encode_ordinary(text[at : m.start()])
            out += self._engine._encode_single_piece(text[m.start() : end])
            at = end
        if at < len(text):
            out += self._engine.encode_ordinary(text[at:])
        return out

    @classmethod
    def read(cls, path: str | None = None) -> str:
        """The vocabulary file's text, to be broadcast (a few MB, whatever the input)."""
        with open(path or default_path(), encoding="utf-8") as f:
            return f.read()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special is None:
                out += self.plain(part)
            else:
                out.append(special)
        return out

    def array(self, text: str) -> np.ndarray:
        """The ids of a text as an array."""
        parts = []
        for part, special in self.segments(text):
            if special is not None:
                parts.append(np.array([special], np.uint32))
            elif self.fast and len(part) < LONG_RUN:
                parts.append(self._engine.encode_to_numpy(part))
            else:
                parts.append(np.array(self.plain(part), np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        if not self.fast:
            return self._library.decode(list(ids), skip_special_tokens=False)
        return self.decode_bytes(ids).decode("utf-8", "replace")


_KEPT: dict[int, ByteBpe] = {}


def of(spec: str) -> ByteBpe:
    """The codec of a broadcast vocabulary, built once in a worker process."""
    key = hash(spec)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = ByteBpe(spec)
    return _KEPT[key]
