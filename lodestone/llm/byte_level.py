"""Encoding by a public byte-level vocabulary, text by text."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .bpe import byte_chars

#: How these files cut a text into words.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer run of white space is more than the fast encoder's stack can look ahead over.
LONG_SPACE = re.compile(r"\s{4096}")


class ByteLevel:
    """Ids as the ``tokenizers`` library gives them for its byte-level file, special tokens not added.

    The ids of these files are the ranks of the merges, so that ``tiktoken``
    makes the same ids in a fraction of the time; texts with very long runs of
    white space go to the library itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, cutter = spec["model"]["vocab"], spec["pre_tokenizer"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        if spec["normalizer"] is not None or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"] or merged != sorted(merged):
            raise ValueError("a byte-level file whose ids follow its merges is needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(self.byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.names = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.names[i] = token
        self.fast = tiktoken.Encoding(path, pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """Ids of a text; with ``special``, special tokens in it are read as such."""
        if LONG_SPACE.search(text):
            self.library.encode_special_tokens = not special
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode(text, allowed_special="all") if special else self.fast.encode_ordinary(text), np.int32)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteLevel:
    return ByteLevel(path)
