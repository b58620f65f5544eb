"""Connected components of links between long ids, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A chain halves in each round, so this many rounds cover any input.
MAX_ROUNDS = 100


def _state(links: DataFrame) -> tuple:
    """Number and order-free checksums of the links, which tell one round's set from another's."""
    code = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(code), F.bit_xor(F.xxhash64("b", "a", F.lit(1))), F.sum(F.pmod(code, F.lit(1 << 31)))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: root is the smallest node reachable.

    Alternating large-star and small-star rounds.  Every round keeps at most
    as many links as there were, hooks nodes onto their smallest neighbour and
    ends its lineage in a table of the shared folder.  A hub with many links is
    a group only for ``min``, which is combined before the shuffle; the join
    that brings the minimum back to the links is an equi-join that adaptive
    execution can split.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, name)
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(lower, "a")
        small = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = written(small, name)
        if before == (before := _state(now)):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
