"""From buckets to components: star-shaped candidate pairs, verified exactly, with no link lost and no group of pairs.

What a set shares. For each set in a crowded bucket, n is its size and r the number of its members that any other such
set has too (shared_counts). Two sets have at most min(r, r') members in common, which bounds their similarity. A copy
with edits of its own has a low r, and the bound tells that it can't be linked, with whomever, without looking at pairs.

1. Sets with r below the threshold's share of n have no link.
2. Every bucket proposes the pairs of its cleanest member (the highest r / n, in a group of edited copies the least
   edited one) with the others: a star, so that pairs stay below the number of memberships. A copy that is linked to
   any other copy is, as a rule, linked to that one.
3. Verified links make components. A bucket whose members are still apart drops those that the bound excludes for all
   sizes in it. What is left outside of the bucket's largest component are its stragglers. They are a query set, held
   against all members of that component and each other in blocks of bounded size, and a block gives at most one link
   for a straggler and component. So each pair that shares a bucket is tested, excluded by the bound, or within one
   component, and no pairs but links are written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm import superkmers as S
from ringledger.llm.common import bundle_of, mix, parts, stored
from ringledger.llm.components import components

#: Sets on either side of a block.
BLOCK = 500
NODE_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def shared_counts(sets: DataFrame, hashes_of: Callable, member_bytes: int, bundle_mb: float = 8.0) -> DataFrame:
    """node, n, r for sets (node, payload). hashes_of(payloads) gives the 64-bit names of all members and n + 1 offsets.

    member_bytes is eight times the number of members of all sets, which the size of a bundle follows.
    Bundles ask by 32-bit names which members occur in other bundles or twice in their own (superkmers.ask); names that
    agree by chance can only raise r.
    """
    n = parts(member_bytes, bundle_mb)
    kind = dict(sets.dtypes)["node"]
    sets = sets.select("node", "payload").withColumn("b", bundle_of(["node"], n))

    def found(table):
        names, first = hashes_of(table["payload"])
        names = mix(names)
        none = np.zeros(0, np.int64)
        return S.Runs(none, none, names, ((names >> np.uint64(32)) % np.uint64(n)).astype(np.int64), none), first

    def asks(key, table):
        return S.ask(key[0].as_py(), found(table)[0])

    def counts(table, answers):
        runs, first = found(table)
        group, _, place, _ = S.names_by_group(runs)
        shared = S.told_bits(group, answers)
        total = np.concatenate(([0], np.cumsum(shared[place]))) if len(place) else np.zeros(first[-1] + 1, np.int64)
        return pa.table([table["node"], pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64())], names=["node", "n", "r"])

    told = sets.groupBy("b").applyInArrow(asks, S.ddl(S.ASK)).groupBy("g").applyInArrow(S.answer, S.ddl(S.ANSWER))
    return sets.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(counts, f"node {kind}, n long, r long")


def allowed(na: Column, ra: Column, nb: Column, rb: Column, threshold: int) -> Column:
    """Whether two sets can be similar enough, as far as n and r tell."""
    most = F.least(ra, rb)
    return 100 * most >= threshold * (na + nb - most)


def first_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """members: bucket, node, n, r. Gives distinct (a, b), a the cleanest node of a bucket with b."""
    centre = members.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "r"), F.struct((-F.col("r") / F.col("n")).alias("x"), "node")).alias("c"), F.count("*").alias("size"))
    centre = centre.filter("size > 1").select(F.col("bucket").alias("_b"), "c")
    pairs = members.join(centre, (F.col("bucket") == F.col("_b")) & (F.col("node") != F.col("c.node")) & allowed(F.col("n"), F.col("r"), F.col("c.n"), F.col("c.r"), threshold))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def stragglers(members: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Distinct (g, node): the nodes of a bucket outside of its largest component, whose root is g."""
    named = stored(members.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("bucket", "node", "n", "r", F.coalesce("root", "node").alias("root")))
    sizes = named.groupBy("bucket").agg(F.min("n").alias("lo"), F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k"))
    apart = sizes.filter("x != y and k > 2").select(F.col("bucket").alias("_b"), "lo")  # a bucket of two is tested by its star
    held = named.join(apart, F.col("bucket") == F.col("_b")).filter(100 * F.col("r") >= threshold * (F.col("n") + F.greatest("r", "lo") - F.col("r"))).select("bucket", "node", "root")
    held = stored(held)
    each = held.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    large = each.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("g"), F.count("*").alias("roots")).filter("roots > 1").select(F.col("bucket").alias("_b"), "g")
    return held.join(large, F.col("bucket") == F.col("_b")).filter("root != g").select("g", "node").distinct()


def block_links(odd: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, hashes_of: Callable, threshold: int) -> DataFrame:
    """Links (a, b) of stragglers (g, node) with the members of component g and with each other, by their hashed sets."""
    kind = dict(nodes.dtypes)["node"]
    rooted = nodes.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"))
    inside = rooted.join(odd.select("g").distinct(), F.col("root") == F.col("g")).select("g", "node", "root")
    outside = odd.join(rooted.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("g", "node", "root")
    every = stored(inside.unionByName(outside))
    count = lambda df, name, out: df.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(out)).select(F.col("g").alias(name), out)
    dealt = count(every, "_g", "blocks").join(count(outside, "_h", "chunks"), F.col("_g") == F.col("_h")).drop("_h")

    def spread(df, own, own_n, other, other_n):
        rows = df.join(dealt, F.col("g") == F.col("_g")).drop("_g")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("node"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return rows.join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("g", "block", "chunk", "node", "root", "payload").toDF("g", "block", "chunk", "node", "root", "payload")

    def links(table, queries):
        if not len(table) or not len(queries):
            return pa.table([pa.array([], NODE_KINDS[kind]), pa.array([], NODE_KINDS[kind])], names=["a", "b"])
        names, first = hashes_of(table["payload"])
        size = np.diff(first)
        node, root = table["node"].to_pylist(), table["root"].to_pylist()
        asked, at = hashes_of(queries["payload"])
        order = np.argsort(names)
        ordered, owner = names[order], np.repeat(np.arange(len(size)), size)[order]
        found = []
        for q, (x, own) in enumerate(zip(queries["node"].to_pylist(), queries["root"].to_pylist(), strict=True)):
            wanted = np.sort(asked[at[q] : at[q + 1]])
            if not len(wanted):
                continue
            begin = np.searchsorted(ordered, wanted)
            times = np.searchsorted(ordered, wanted, side="right") - begin
            held = np.arange(times.sum()) + np.repeat(begin - (np.cumsum(times) - times), times)
            both = np.bincount(owner[held], minlength=len(size))
            seen = {own}
            for i in np.flatnonzero(100 * both >= threshold * (size + len(wanted) - both)).tolist():
                if root[i] not in seen:
                    seen.add(root[i])
                    found.append((min(x, node[i]), max(x, node[i])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, NODE_KINDS[kind]), pa.array(b, NODE_KINDS[kind])], names=["a", "b"])

    left = spread(every, "block", "blocks", "chunk", "chunks").groupBy("g", "block", "chunk")
    right = spread(outside, "chunk", "chunks", "block", "blocks").groupBy("g", "block", "chunk")
    return left.cogroup(right).applyInArrow(links, f"a {kind}, b {kind}").distinct()


def resolve(members: DataFrame, sets: DataFrame, hashes_of: Callable, member_bytes: int, threshold: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root for each node that has a link.

    members: bucket, node; sets: node, payload; hashes_of(payloads) gives the 64-bit names of all members, once a set,
    and n + 1 offsets; verify(pairs) keeps the links among pairs (a, b).
    """
    sizes = shared_counts(sets, hashes_of, member_bytes)
    likely = stored(sizes.filter(100 * F.col("r") >= threshold * F.col("n")))
    members = stored(members.join(likely.select(F.col("node").alias("_n"), "n", "r"), F.col("node") == F.col("_n")).select("bucket", "node", "n", "r"))
    links = stored(verify(stored(first_pairs(members, threshold))))
    roots = components(links)
    odd = stored(stragglers(members, roots, threshold))
    if odd.isEmpty():
        return roots
    more = stored(verify(stored(block_links(odd, roots, likely.select("node"), sets, hashes_of, threshold))))
    if more.isEmpty():
        return roots
    return components(roots.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
