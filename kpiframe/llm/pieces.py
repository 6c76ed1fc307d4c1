"""Cutting texts into independently encoded pieces for a byte-level BPE file of the ``tokenizers`` library.

Merges never cross pre-tokens, and no pre-token of the byte-level pattern runs from a non-blank into a blank.
So a text may be cut before any blank that follows a non-blank, or that precedes one; each piece (blanks and the
word behind them, one or more whole pre-tokens) then has its own ids, whatever stands around it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

#: A blank between two blanks (or before the end): cutting in front of it would cut a run of blanks.
_INSIDE_RUN = re.compile(r"\s (?!\S)")
_BEFORE_RUN = re.compile(r"(?<=\S)(?= )")


class Cutter:
    """Cuts texts into piece keys. A key without a leading blank stands for a blank and the key; one with it, for the rest."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normalizer, post-processor and prefix blank is needed")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("added tokens that strip blanks, match whole words or are normalised are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def keys(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [" " + part] if i % 2 else self._plain(part)
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text:
            return []
        if _INSIDE_RUN.search(text):
            return [" " + part for part in _BEFORE_RUN.split(text)]
        keys = text.split(" ")
        keys[0] = " " + keys[0]
        return keys


def piece_of(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


_loaded: dict[int, tuple] = {}


def tools(tokenizer_json: str):
    """(Cutter, Tokenizer) of this worker, loaded once per file content."""
    mark = hash(tokenizer_json)
    if mark not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.clear()
        _loaded[mark] = (Cutter(tokenizer_json), tokenizer)
    return _loaded[mark]


def forget() -> None:
    """Drop the tokenizer that this worker holds."""
    _loaded.clear()


def encode_keys(tokenizer, keys: list[str]) -> list[list[int]]:
    """Ids of each key's piece, as the library encodes the piece."""
    return [e.ids for e in tokenizer.encode_batch_fast([piece_of(k) for k in keys], add_special_tokens=False)]


def ship(spark: SparkSession, path: str):
    """The tokenizer file's text as a broadcast variable (a file of a few MB; executors need not have it)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    Cutter(text)
    return spark.sparkContext.broadcast(text)
