"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves; a tree for each group of rows (a source), and one more tree over the groups'
roots. Nodes are labelled (tree, level, index), so that children have smaller labels than their
parent. A node sends its digest to its parent's label; messages wait in an external priority queue
that is ordered by label. The queue is Spark's shuffle: one level of all trees is taken out at a
time, each label with the at most `arity` messages that wait for it, and every level is a written
table a sixteenth the size of the one before. The reversed sweep goes from the roots down: a node
hands each child the siblings at the child's left and right before its own suffix, so that a leaf
receives its whole proof. Leaves are shuffled twice, for their places and for their parents, and
never again: what belongs to a leaf waits within its parent's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .mixing import ranked

#: Columns of a leaf, in the order in which they are hashed.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
_PATH = "array<struct<left:binary,right:binary>>"


def leaf_digest(*values: Column) -> Column:
    """sha-256 (binary) of the values: `-` for a null, else the UTF-8 byte count, `:` and the value; integers as decimals."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def to_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def proof_text(path: Column) -> Column:
    """All siblings of a proof, as hex: level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(to_hex(x["left"]), to_hex(x["right"]))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root (hex) that a leaf's digest (binary) and its proof lead to."""
    return F.aggregate(path, to_hex(digest), lambda h, x: F.sha2(F.concat(to_hex(x["left"]), h, to_hex(x["right"])), 256))


def _climb(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """Levels of a forest. leaves: tree, idx (from 0), total (leaves of the tree), digest, mine (struct of what belongs to the leaf).

    Level 0 are the leaves; each further one has tree, idx, total (nodes of the tree at that level), digest, kids (mine and digest by place).
    """
    levels = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        below = levels[-1].filter("total > 1")
        kid = F.struct(F.col("idx"), F.col("digest"), *([F.col("mine")] if len(levels) == 1 else []))
        waiting = below.groupBy("tree", F.expr(f"idx div {arity}").alias("label"), F.expr(f"(total + {arity - 1}) div {arity}").alias("total")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("kids", lambda k: to_hex(k["digest"])), ""), 256))
        levels.append(materialize(waiting.select("tree", F.col("label").alias("idx"), "total", digest.alias("digest"), "kids"), name))
        most = -(-most // arity)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree: its only node, at whatever level it is."""
    out = None
    for level in levels:
        found = level.filter("total = 1").select("tree", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def _side(lower: Column, upper: Column) -> Column:
    """Digests of the kids at places from lower to before upper, one after the other."""
    return F.aggregate(F.slice("kids", lower + 1, upper - lower), F.lit(b""), lambda s, k: F.concat(s, k["digest"]))


def _handed_down(level: DataFrame, suffixes: DataFrame) -> DataFrame:
    """What the nodes of a level hand to their kids: tree, kid, total, root, path."""
    known = level.select("tree", "idx", "kids").join(suffixes, ["tree", "idx"])
    each = known.select("tree", "kids", "root", "path", F.posexplode("kids").alias("at", "kid"))
    own = F.struct(_side(F.lit(0), F.col("at")).alias("left"), _side(F.col("at") + 1, F.size("kids")).alias("right"))
    return each.select("tree", "kid", "root", F.concat(F.array(own), "path").alias("path"))


def _descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """mine, digest, root and path of every leaf. roots: tree, root (its digest), path (what is above it)."""
    suffixes = None
    for k in range(len(levels) - 1, 0, -1):
        tops = levels[k].filter("total = 1").select("tree", "idx").join(roots, "tree")
        suffixes = tops if suffixes is None else suffixes.unionByName(tops)
        handed = _handed_down(levels[k], suffixes)
        if k > 1:
            suffixes = handed.select("tree", F.col("kid.idx").alias("idx"), "root", "path")
        else:
            below = handed.select(F.col("kid.mine").alias("mine"), F.col("kid.digest").alias("digest"), "root", "path")
    alone = levels[0].filter("total = 1").join(roots, "tree").select("mine", "digest", "root", "path")
    return alone if len(levels) == 1 else below.unionByName(alone)


def manifest(docs: DataFrame, columns: tuple[str, ...] = LEAF, by: str = "source", order: str = "doc_id", arity: int = ARITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: the columns named in carry, and leaf, subroot, root (hex), path (the proof: left and right siblings by level).

    A leaf is the digest of columns. Leaves of a group (by; null is a group and comes first, others
    ascend bytewise) ascend by `order`, nulls first, and ties by digest: repeated rows are leaves of
    their own. While a tree has several nodes, every `arity` consecutive ones become one, a last run
    may be shorter; a lone leaf is its group's root, and a lone group's root is the root. Empty texts
    are values, not nulls. Columns of docs that are not named are ignored; an empty table gives no rows.
    """
    if arity < 2:
        raise ValueError("a node has two children at least")
    mine = F.struct(*[c.alias(n) for n, c in (carry or {}).items()]) if carry else F.struct(F.lit(None).cast("string").alias("nothing"))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("at"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"), mine.alias("mine"),
    )
    placed = materialize(ranked(leaves, ["tree"], ["at", "digest"], total="total").select("tree", F.col("rank").alias("idx"), "total", "digest", "mine"), "leaves")
    levels = _climb(placed, arity, "nodes")
    groups = _roots(levels).withColumn("all", F.lit(""))
    groups = ranked(groups, ["all"], ["tree"], total="total").select(F.col("all").alias("tree"), F.col("rank").alias("idx"), "total", "digest", F.struct(F.col("tree").alias("group")).alias("mine"))
    groups = materialize(groups, "roots")
    top = _climb(groups, arity, "root-nodes")
    root = _roots(top).first()
    roots = _roots(top).select("tree", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    above = materialize(_descend(top, roots).select(F.col("mine.group").alias("tree"), F.col("digest").alias("root"), "path"), "above")
    release(*top)
    proofs = _descend(levels, above)
    given = [F.col(f"mine.{n}").alias(n) for n in carry or {}]
    return proofs.select(*given, to_hex(F.col("digest")).alias("leaf"), to_hex(F.col("root")).alias("subroot"), F.lit(root and bytes(root["digest"]).hex()).alias("root"), "path")
