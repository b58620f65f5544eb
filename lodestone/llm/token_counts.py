"""Token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are runs of word characters, each with the mark of a word start
before it, and runs of other characters but white space.  A pre-token is segmented into pieces of a
public vocabulary by a unigram model: the best segmentation has the largest
sum of log probabilities, ties go to fewer tokens.  No tokenizer is trained:
the probabilities follow Zipf's law over the file's own order, 1/(rank + 10);
a character that no piece covers becomes its UTF-8 bytes, each with the
probability of the rank behind the last.

The distinct pre-tokens of a group of texts that are not known yet are
inserted in a trie.  A node stands for a prefix and holds its forward score;
as a piece that ends at a node reaches back over its ancestors only, the score
is computed once for all pre-tokens that share the prefix.  Where a pre-token
ends, the node keeps its token count.  The count of a text is the sum over its
pre-tokens.

Defined cases: a null text counts as empty and has no tokens; equal rows give
equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _clean, _groups, _types, public_path
from .common import table
from .pieces import normal_pieces

MARK = "▁"
PRE_TOKEN = re.compile(r"\w+|[^\w\s]+")
ZIPF_SHIFT = 10
#: Nodes beyond which a worker starts its trie anew before the next group.
NODES = 500_000
#: Characters of text that are counted together.
GROUP_CHARS = 2_000_000


class Trie:
    """Prefixes of pre-tokens with their best segmentation scores."""

    def __init__(self, path: str) -> None:
        pieces = normal_pieces(path)
        self.score = {p: -math.log(rank + ZIPF_SHIFT) for rank, (p, _) in enumerate(pieces)}
        self.byte = -math.log(len(pieces) + ZIPF_SHIFT)
        self.longest = max((len(p) for p in self.score), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # (log probability, minus the number of tokens) of a node
        self.terminal: dict[str, int] = {}  # pre-token -> count at the node where it ends
        self.visited = 0

    def insert(self, token: str) -> int:
        """Adds a pre-token; its number of tokens."""
        node, path = 0, [0]
        child, best, score = self.child, self.best, self.score
        for end, c in enumerate(token, 1):
            at = child.get((node, c))
            if at is None:
                at = child[node, c] = len(best)
                n = len(c.encode("utf-8", "surrogatepass"))
                s, m = best[node]
                top = (s + score[c], m - 1) if c in score else (s + n * self.byte, m - n)
                for size in range(2, min(self.longest, end) + 1):
                    found = score.get(token[end - size : end])
                    if found is not None:
                        s, m = best[path[end - size]]
                        if (s + found, m - 1) > top:
                            top = (s + found, m - 1)
                best.append(top)
                self.visited += 1
            node = at
            path.append(node)
        return -best[node][1]


@lru_cache(maxsize=2)
def loaded(path: str) -> Trie:
    return Trie(path)


def count_batch(trie: Trie, texts: list[str]) -> list[tuple[int, int]]:
    """Pre-tokens and tokens of every text."""
    if len(trie.best) + len(trie.terminal) > NODES:
        trie.clear()
    rows = [PRE_TOKEN.findall(t) for t in texts]
    counts = trie.terminal
    for w in {w for row in rows for w in row}:
        if w not in counts:
            counts[w] = trie.insert(MARK + w if w[0] == "_" or w[0].isalnum() else w)
    return [(len(row), sum(map(counts.__getitem__, row))) for row in rows]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_pre_tokens, n_tokens`` for every row of ``docs``."""
    frame = docs.select(id_col, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = loaded(path)
        for batch in batches:
            for a, b in _groups(batch.column(1), GROUP_CHARS):
                found = np.array(count_batch(trie, _clean(batch.column(1).slice(a, b - a))), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[id_col, "n_pre_tokens", "n_tokens"])

    return frame.mapInArrow(run, f"{_types(frame.select(id_col))}, n_pre_tokens long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"), path or public_path("piece_bpe_32k.model"))
