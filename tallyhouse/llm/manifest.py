"""Merkle manifest of a table: a digest for every row, for every group of rows and for the whole, with membership proofs.

A tree hashes runs of ``fan`` consecutive nodes into one until a single node remains. Nodes keep their place among the leaves
of their tree, so the run, the slot in it and the run's length follow from the place and the number of leaves alone. Aligned
blocks of ``fan ** DEPTH`` leaves never cut a run; a round climbs up to ``DEPTH`` levels inside such blocks, and the blocks'
tops are the leaves of the next round. A tree of any size therefore has no task that holds more than a block of it.

Inside a block each level is a window over the same sorted rows: a node is held by the row of its first leaf, fixed-offset
``lag`` and ``lead`` columns masked by slot and run length give its siblings, and the row of a run's first child hashes the
parent. Siblings reach the leaves below by the last value seen in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written
from tallyhouse.operators.paging import number_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAVES = 1024  # leaves of a block at most; windows keep a block in memory

_SIBLINGS = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field_text(value: Column) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and its value, so that fields never run together; null is ``-``."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*[field_text(value) for value in fields.values()])


def levels_per_round(fan: int, most: int) -> int:
    """The levels that trees of ``most`` leaves need, but no more than give blocks of ``LEAVES`` leaves, and at least one."""
    depth = 1
    while fan**depth < most and fan ** (depth + 1) <= LEAVES:
        depth += 1
    return depth


def _climbed(nodes: DataFrame, fan: int, depth: int) -> tuple[DataFrame, list[str]]:
    """``nodes`` (tree, at, n, hash, ...) with ``top``, the block's digest in its first row, and siblings per level."""
    block = fan**depth
    rows = nodes.withColumn("block", F.expr(f"at div {block}"))
    order = Window.partitionBy("tree", "block").orderBy("at")
    rows = rows.withColumn("node", F.col("hash"))
    names = []
    for level in range(depth):
        step = fan**level
        place = F.expr(f"at div {step}")
        holds = F.expr(f"at % {step} = 0")
        slot = place % fan
        size = F.expr(f"(n + {step - 1}) div {step}")
        length = F.least(F.lit(fan).cast("bigint"), size - (place - slot))
        before = [
            F.when(slot >= d, F.lag("node", d * step).over(order)).otherwise("") for d in range(fan - 1, 0, -1)
        ]
        after = [F.when(slot + d < length, F.lead("node", d * step).over(order)).otherwise("") for d in range(1, fan)]
        name = f"level{level}"
        names.append(name)
        own = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
        # A tree of one node is its own root: no level stands above it.
        rows = rows.withColumn(name, F.when(holds & (size > 1), own))
        parent = F.when(size > 1, digest("node", F.col(f"{name}.after"))).otherwise(F.col("node"))
        rows = rows.withColumn("node", F.when(holds & (slot == 0), parent))
    return rows, names


def _spread(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every row gets the siblings of all nodes above it, from the leaf level up."""
    order = Window.partitionBy("tree", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("*", *[F.last(name, ignorenulls=True).over(order).alias(f"_{name}") for name in names])
    path = F.filter(F.array(*[f"_{name}" for name in names]), lambda s: s.isNotNull())
    return seen.withColumn("path", path).drop(*names, *[f"_{name}" for name in names])


def climbed(nodes: DataFrame, fan: int = 2) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes``: (rows with ``path``, one row per tree with ``root``).

    ``nodes`` has tree (long), at (long, 0 to n - 1 without gaps), n (long, leaves of the tree), hash and further columns.
    ``path`` is an array of (before, after), the digests of the siblings left and right, from the leaves to the root; a tree
    of one leaf has an empty one and the leaf as root. An empty table gives no rows on either side. The number of rounds is
    that of the deepest tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    depth = levels_per_round(fan, most)
    block = fan**depth
    rounds = [nodes.select("tree", "at", "n", "hash")]
    while most > 1:
        rows, _ = _climbed(rounds[-1], fan, depth)
        tops = rows.where(F.expr(f"at % {block} = 0")).select(
            "tree", F.col("block").alias("at"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.col("node").alias("hash")
        )
        rounds.append(written(tops))
        most = -(-most // block)
    roots = rounds[-1].where("at = 0").select("tree", F.col("hash").alias("root"))
    above = None
    for level in reversed(range(len(rounds) - 1)):
        source = nodes if level == 0 else rounds[level]
        rows = _spread(*_climbed(source, fan, depth)).drop("node")
        if above is not None:
            upper = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("path").alias("_upper"))
            rows = rows.join(upper, (rows["tree"] == upper["_tree"]) & (rows["block"] == upper["_block"]))
            rows = rows.withColumn("path", F.concat("path", "_upper")).drop("_tree", "_block", "_upper")
        above = rows.drop("block")
    if above is None:
        above = nodes.withColumn("path", F.array().cast(f"array<{_SIBLINGS}>"))
    return above, roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, left to right, from the leaves to the root."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""))


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    key: str = "doc_id",
    fan: int = 2,
    altered: dict[str, Column] | None = None,
    where_altered: Column | None = None,
) -> DataFrame:
    """One row per input row: ``key``, ``group``, leaf, subroot, root, path and check_leaf.

    Leaves of a group ascend by key; equal keys follow by leaf, so the digests do not depend on how rows arrive. Nulls come
    first, among keys and among groups: rows without a group form one. Repeated rows are leaves of their own. Texts of any
    length are hashed where they are read and never travel. Columns besides ``fields`` play no part, whatever their names.
    An empty table gives no rows. ``altered`` names fields to read otherwise in rows for which ``where_altered`` holds:
    ``check_leaf`` is the leaf of what is found there, in all other rows the leaf itself.
    """
    original = {name: F.col(f"`{name}`") for name in fields}
    leaf = leaf_digest(original)
    found = leaf
    if altered:
        found = F.when(F.coalesce(where_altered, F.lit(False)), leaf_digest(original | altered)).otherwise(leaf)
    leaves = rows.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("part"), leaf.alias("hash"), found.alias("check_leaf")
    )
    numbered = number_rows(leaves, [F.asc_nulls_first("part"), F.asc_nulls_first("key"), F.asc("hash"), F.asc("check_leaf")])
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
    parts = number_rows(sizes, [F.asc_nulls_first("part")])
    parts = written(parts.select(F.col("part").alias("_part"), "n", "first", (F.col("rn") - 1).alias("tree")))
    # A table of groups: its size is known once written, and Spark sends it along only while it is small.
    placed = numbered.join(parts, numbered["part"].eqNullSafe(parts["_part"]))
    nodes = placed.select("tree", (F.col("rn") - F.col("first")).alias("at"), "n", "hash", "key", "part", "check_leaf")
    paths, subroots = climbed(nodes, fan)
    many = parts.agg(F.count(F.lit(1)).alias("n"))
    subroots = written(subroots)
    tops = subroots.crossJoin(F.broadcast(many)).select(  # one row: the number of groups
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "n", F.col("root").alias("hash")
    )
    upper, roots = climbed(tops, fan)
    upper = written(upper.select(F.col("at").alias("_tree"), F.col("hash").alias("subroot"), F.col("path").alias("_upper")))
    joined = paths.join(upper, paths["tree"] == upper["_tree"]).crossJoin(F.broadcast(roots.select("root")))
    return joined.select(
        F.col("key").alias(key), F.col("part").alias(group), F.col("hash").alias("leaf"), "subroot", "root",
        F.concat("path", "_upper").alias("path"), "check_leaf",
    )


def verified(rows: DataFrame, fan: int = 2, **changes: Column | dict[str, Column]) -> DataFrame:
    """``manifest`` with the digest of each proof, the root folded from ``check_leaf``, and whether that is the root."""
    found = manifest(rows, fan=fan, **changes)
    out = found.withColumn("proof_sha256", proof_digest(F.col("path")))
    out = out.withColumn("folded_root", folded(F.col("check_leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering(n_chars: str = "n_chars", key: str = "doc_id", every: int = 7) -> dict:
    """A trial of the manifest: where ``every`` divides the key's CRC-32, ``n_chars`` is read as one more (nulls stay)."""
    return {
        "altered": {n_chars: F.col(f"`{n_chars}`") + 1},
        "where_altered": F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % every == 0,
    }

