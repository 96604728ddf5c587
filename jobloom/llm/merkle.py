"""Merkle manifest of a dataset: one tree of digests a group, and one over the groups' roots.

The leaves of a group stand in the order of their ids; every ``arity`` consecutive nodes become a parent (the last run
may be shorter, down to one node), until one node is left. Levels are built by sibling-shift self-joins: each level is
equijoined with itself on computed sibling places (XOR 1 for pairs, slot offsets otherwise), and the rows in slot zero
emit the parents. A node keeps what stands before and after it in its run, so a row's proof is the list of these from
its leaf to the root: ``H(before || digest || after)`` climbs one level. Proofs come down from the root again, one
equijoin a level, each node's own step before its parent's.

Every level is written to the shared folder, so lineage stays short; a level has 1/arity of the nodes below it. Places
are numbered by a range sort, so no group's rows meet in one task. What is broadcast is one row a group, counted first.

Defined results: null fields are encoded as ``-``, unlike an empty text (``0:``); rows without id come first, rows that
agree in id are ordered by leaf, and equal rows each have a leaf; the null group comes first; a group of one row has its
leaf as root; an empty table gives an empty manifest; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, numbered, read_table, stored

#: Nodes of one run.
ARITY = 2


def hashed(*parts) -> F.Column:
    """H: hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: F.Column) -> F.Column:
    """A value with its length, or ``-``, so that no two rows are encoded alike."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: F.Column) -> F.Column:
    return hashed(*map(field, values))


def folded(start: F.Column, steps: F.Column) -> F.Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(steps, start, lambda digest, step: hashed(step["before"], digest, step["after"]))


def proof_digest(steps: F.Column) -> F.Column:
    """H of the siblings, level by level, each level from left to right."""
    return hashed(F.array_join(F.transform(steps, lambda step: F.concat(step["before"], step["after"])), ""))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``before`` and ``after`` of every node: the digests of its run to its left and right."""
    slot = F.pmod("at", F.lit(arity))
    out = nodes
    for shift in range(1, arity):
        # the row in slot s gets the digest of slot s + shift, counted round
        place = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + F.pmod(slot - shift, F.lit(arity))
        out = out.join(nodes.select("tree", place.alias("at"), F.col("digest").alias(f"s{shift}")), ["tree", "at"], "left")
    around = lambda left: F.concat_ws("", *[F.when((slot + s >= arity) if left else (slot + s < arity), F.col(f"s{s}")) for s in range(1, arity)])
    return out.select("tree", "at", "n", "digest", F.expr(f"at div {arity}").alias("up"), around(True).alias("before"), around(False).alias("after"))


def grown(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], dict[int, DataFrame]]:
    """Levels and finished trees of (tree, at, n, digest), where n is the number of a tree's nodes at the level.

    ``levels[k]`` holds the nodes of level k with their siblings, ``tops[k]`` the roots that stand at level k.
    """
    height = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.conv((F.col("n") - 1).cast("string"), 10, arity)))
    ends = {r[0] for r in leaves.select(height.alias("height")).distinct().collect()} or {0}  # 64 heights at most
    levels, tops, nodes = [], {}, leaves
    for k in range(max(ends) + 1):
        if k in ends:
            tops[k] = nodes.filter("n = 1").select("tree", "at", "digest")
        if k < max(ends):
            levels.append(stored(_siblings(nodes.filter("n > 1"), arity), f"merkle-{k}"))
            up = lambda c, more: F.expr(f"({c} + {more}) div {arity}")
            first = levels[-1].filter(F.pmod("at", F.lit(arity)) == 0)
            nodes = first.select("tree", up("at", 0).alias("at"), up("n", arity - 1).alias("n"), hashed("digest", "after").alias("digest"))
    return levels, tops


def roots(tops: dict[int, DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    return reduce(DataFrame.union, tops.values()).select("tree", "digest")


def proofs(levels: list[DataFrame], tops: dict[int, DataFrame], onward: DataFrame) -> DataFrame:
    """(tree, at, steps) of every leaf; ``onward`` has the ``steps`` that follow each tree's root."""
    ends = {k: top.select("tree", "at").join(onward, "tree") for k, top in tops.items()}
    paths = ends[len(levels)]
    for k in reversed(range(len(levels))):
        parents = paths.select("tree", F.col("at").alias("up"), F.col("steps").alias("rest"))
        own = levels[k].select("tree", "at", "before", "after", "up").join(parents, ["tree", "up"])
        paths = own.select("tree", "at", F.concat(F.array(F.struct("before", "after")), "rest").alias("steps"))
        paths = paths.union(ends[k].select("tree", "at", "steps")) if k in ends else paths
    return paths


NO_STEPS = "cast(array() AS array<struct<before: string, after: string>>)"


def manifest(df: DataFrame, id_col: str, group_col: str, value_cols: list[str], arity: int = ARITY, keep: dict | None = None) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root`` and ``steps`` (the proof) of every row, and the columns ``keep``."""
    keep = keep or {}
    own = df.select(df[id_col].alias("id"), df[group_col].alias("part"), leaf(*[df[c] for c in value_cols]).alias("leaf"), *[c.alias(f"keep_{k}") for k, c in keep.items()])
    first = lambda c: F.col(c).asc_nulls_first()
    placed = numbered(stored(own, "merkle-leaves"), [first("part"), first("id"), first("leaf")], "merkle-order")
    groups = numbered(placed.groupBy("part").agg(F.min("place").alias("start"), F.count("*").alias("n")), [first("part")], "merkle-groups", "tree")
    named = placed.join(checked(groups), placed["part"].eqNullSafe(groups["part"])).drop("part")
    rows = stored(named.withColumn("at", F.col("place") - F.col("start")).drop("place", "start"), "merkle-rows")

    levels, tops = grown(rows.select("tree", "at", "n", F.col("leaf").alias("digest")), arity)
    subroots = stored(roots(tops), "merkle-subroots")
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(subroots.count()).cast("long").alias("n"), "digest")
    upper, summit = grown(above, arity)
    end = roots(summit).select("tree", F.expr(NO_STEPS).alias("steps"))
    onward = stored(proofs(upper, summit, end).select(F.col("at").alias("tree"), "steps"), "merkle-onward")
    paths = proofs(levels, tops, checked(onward))

    root = roots(summit).select(F.col("digest").alias("root"))  # one row
    named = checked(subroots.select("tree", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root)))
    out = rows.join(paths, ["tree", "at"]).join(named, "tree")
    return out.select("id", "leaf", "subroot", "root", "steps", *[F.col(f"keep_{k}").alias(k) for k in keep])


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13(spark, sf_dir):
    """Leaf, roots, proof and check of every document; one in seven is checked with one character more than it has."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:])
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(odd, leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]))
    rows = manifest(docs, "doc_id", "lang", COLUMNS, keep={"shown": shown})
    end = folded(F.coalesce("shown", "leaf"), F.col("steps"))
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
