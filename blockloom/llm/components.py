"""Splits that keep related records together: hash-to-min components, rendezvous hashing.

Ties are rows (token, record): records that share a token are tied, and so on through others.
Hash-to-min on pairs (node, member): in each round a node sends its cluster to its smallest
member, and that smallest member to all of its cluster. Clusters are kept as rows, never as
arrays, so a component with a third of all records is a third of the rows and not one value.
Each round is written to the shared checkpoint folder; the rounds end when none changes
a pair, after about twice the logarithm of the longest chain.

Splits: whole components are assigned by weighted rendezvous hashing on the component's id,
so the result doesn't depend on order, partitions or other components, and a larger share of a
split only moves components into it. The shares are those of the expectation; a component that
holds a tenth of all weight can't be divided, and moves them by as much. Where near shares count
more than stability, ``placed_above`` places the components that hold more than this share of the
weight first, the largest into the split that lacks most, and the hashing fills the rest.

Defined results: null tokens and null records tie nothing; a token with one record ties
nothing; repeated rows count once; ids are compared as exact strings; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import cut

ROUNDS = 60
HOT = 100_000  # members from which a node's cluster is no task of its own


def star_edges(ties: DataFrame) -> DataFrame:
    """(a, b) pairs that tie each record of a token to the token's smallest record. ties: (token, record)."""
    rows = ties.filter("token is not null and record is not null").distinct()
    least = rows.groupBy("token").agg(F.min("record").alias("a"), F.max("record").alias("z")).filter("a < z")
    return rows.join(least, "token").filter("record <> a").select("a", F.col("record").alias("b")).distinct()


def with_least(pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """(v, u, m): each pair with the smallest member of v's cluster.

    A component of a third of all records is one cluster of its smallest node: clusters of more than ``hot``
    members, at most a ``hot``-th of all pairs, are looked up by broadcast and not brought together by key.
    """
    least = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    large = F.broadcast(least.filter(F.col("n") > hot).select("v", "m"))
    small = pairs.join(large.select("v"), "v", "left_anti").join(least.filter(F.col("n") <= hot).select("v", "m"), "v")
    return small.select("v", "u", "m").unionByName(pairs.join(large, "v").select("v", "u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(record, group_id) of every record with an edge; group_id is the smallest record of its component."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    own = both.select("v", F.col("v").alias("u"))
    pairs = cut(both.unionByName(own).distinct())
    before = None
    for _ in range(ROUNDS):
        sent = with_least(pairs)
        pairs = cut(sent.select(F.explode(F.array(
            F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))
        )).alias("p")).select("p.v", "p.u").distinct())
        # a pass over the pairs tells whether the round changed any
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {ROUNDS} rounds")
    return pairs.groupBy(F.col("u").alias("record")).agg(F.min("v").alias("group_id"))


def groups_of(ties: DataFrame) -> DataFrame:
    return components(star_edges(ties))


def rendezvous(group: Column, shares: Mapping[str, float], seed: str = "0") -> Column:
    """The split with the largest -share / ln(u), u in (0, 1) from 52 bits of the MD5 of seed, split and group."""
    points = []
    for name, w in sorted(shares.items()):
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), group)), 1, 13), 16, 10).cast("bigint")
        points.append(F.struct((F.lit(-float(w)) / F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52)))).alias("score"), F.lit(name).alias("split")))
    return F.greatest(*points)["split"] if len(points) > 1 else points[0]["split"]


def assign_splits(
    records: DataFrame, groups: DataFrame, shares: Mapping[str, float], seed: str = "0", placed_above: float | None = None
) -> DataFrame:
    """(record, group_id, split) of each record. records: (record, weight), one row each; groups: (record, group_id)."""
    every = records.join(groups, "record", "left").select("record", F.coalesce("group_id", "record").alias("group_id"), "weight")
    if placed_above is None:
        return every.select("record", "group_id", rendezvous(F.col("group_id"), shares, seed).alias("split"))
    every = cut(every)
    total = float(every.agg(F.sum("weight")).first()[0] or 0)
    sizes = every.groupBy("group_id").agg(F.sum("weight").alias("size"))
    large = sizes.filter(F.col("size") > placed_above * total).orderBy(F.desc("size"), "group_id").collect() if total else []
    lack = {k: v / sum(shares.values()) * total for k, v in shares.items()}
    placed = {}
    for row in large:  # fewer than 1 / placed_above rows
        placed[row["group_id"]] = best = max(lack, key=lambda k: (lack[k], k))
        lack[best] -= row["size"]
    rest = {k: max(v, 0.0) for k, v in lack.items()}
    split = rendezvous(F.col("group_id"), rest if any(rest.values()) else shares, seed)
    if placed:
        known = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])
        split = F.coalesce(known[F.col("group_id")], split)
    return every.select("record", "group_id", split.alias("split"))
