"""Merkle manifest of a table: one tree for each value of a column, the trees' roots under one root, a proof per row.

A node covers an interval of leaf ranks.  At level L it lies in bucket ``lo div fanout**L``, so an ancestor is found by
tree and bucket and holds the node if its interval contains the node's (a containment join by level).  Its siblings are
what is left of the parent's interval without its own: the parent's parts that end before it, and those that begin
after it.  Proofs are handed down from the root, one level a join, where each parent meets ``fanout`` children at most;
rows take theirs from the lowest node, which holds them already, so wide proofs are never shuffled row by row.

Ranks come from a range sort and one number for each range; a tree with most of the rows is sorted and hashed in as many
tasks as its rows need.  Texts are read once.

Nulls: a null field is ``-``; null trees come first, null keys first in their tree.  Rows of one key are in the order
of their leaves, so rows that are equal in all fields are interchangeable.  A tree of one row has its leaf as root.  An
empty table has no rows.  Other columns of the table do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import positions
from .shared import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings on one level of a proof: digests one after another.
_SIDES = "array<struct<left: string, right: string>>"


def digest(*fields: Column) -> Column:
    """Lowercase SHA-256 of fields written as ``-`` for null, else as byte count, colon and value."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written), 256)


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, digest, more) with ``lo`` (rank in the tree from 0), ``hi`` and ``n`` (leaves of the tree)."""
    kept = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = positions(kept.orderBy("tree", "key", "digest", "tie"), "at").drop("tie")
    trees = stored(placed.groupBy(F.col("tree").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    out = placed.join(trees, F.col("tree").eqNullSafe(F.col("of")))
    return out.withColumns({"lo": F.col("at") - F.col("first"), "hi": F.col("at") - F.col("first") + 1}).drop("of", "first", "at", "key")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes above ranked leaves, lowest level first: tree, n, lo, hi, digest and ``parts`` (their children, in order).
    Trees end at the level of one node.  The lowest level has a node for a tree of one leaf too, with the leaf's digest."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    out, below, width = [], leaves, fanout
    while True:
        part = F.struct("lo", "hi", "digest", *(c for c in below.columns if c == "more")).alias("part")
        runs = below.groupBy("tree", "n", F.expr(f"lo div {width}").alias("bucket")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
        joined = F.sha2(F.concat_ws("", "parts.digest"), 256)
        runs = runs.select("tree", "n", "bucket", F.col("parts")[0]["lo"].alias("lo"), F.element_at("parts", -1)["hi"].alias("hi"), F.when(F.col("n") == 1, F.col("parts")[0]["digest"]).otherwise(joined).alias("digest"), "parts")
        out.append(stored(runs, "level"))
        if width >= most:
            return out
        below = out[-1].where(F.col("n") > width).select("tree", "n", "lo", "hi", "digest")
        width *= fanout


def tree_roots(nodes: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that covers all of its tree."""
    tops = None
    for df in nodes:
        top = df.where("lo = 0 AND hi = n").select("tree", "digest")
        tops = top if tops is None else tops.unionByName(top)
    return tops


def _outside(parts: str, lo: str, hi: str) -> Column:
    """What the parent's interval has besides [lo, hi): digests of the parts before and after it."""
    left = f"array_join(transform(filter({parts}, p -> p.hi <= {lo}), p -> p.digest), '')"
    right = f"array_join(transform(filter({parts}, p -> p.lo >= {hi}), p -> p.digest), '')"
    return F.expr(f"named_struct('left', {left}, 'right', {right})")


def handed_down(nodes: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The lowest nodes with ``proof`` (sides level by level, from the node itself to the root of all), ``subroot`` and
    ``root``.  ``tops``: tree, subroot, root and the proof of the tree's own root."""
    above, tops = None, tops.withColumnRenamed("tree", "of")
    for at in range(len(nodes) - 1, -1, -1):
        whole = nodes[at].where("lo = 0 AND hi = n").join(tops, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
        if above is not None:
            bucket = F.expr(f"lo div {fanout ** (at + 2)}")
            parent = above.select(F.col("tree").alias("p_tree"), F.col("bucket").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("parts").alias("p_parts"), "proof", "subroot", "root")
            contained = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("of_bucket") == F.col("p_bucket")) & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))
            part = nodes[at].where("hi - lo < n").withColumn("of_bucket", bucket).join(parent, contained)
            part = part.withColumn("proof", F.concat(F.array(_outside("p_parts", "lo", "hi")), "proof"))
            whole = whole.unionByName(part.select(*whole.columns))
        above = whole
    return above


def proofs(placed: DataFrame) -> DataFrame:
    """The leaves of the lowest nodes: tree, leaf, more, subroot, root and their proof up to the root of all."""
    rows = placed.select("tree", "n", "parts", "proof", "subroot", "root", F.explode("parts").alias("own"))
    own = F.when(F.col("n") == 1, F.array().cast(_SIDES)).otherwise(F.array(_outside("parts", "own.lo", "own.hi")))
    more = ["own.more"] if "more" in placed.schema["parts"].dataType.elementType.names else []
    return rows.select("tree", F.col("own.digest").alias("leaf"), *more, "subroot", "root", F.concat(own, "proof").alias("proof"))


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and its siblings give, level by level."""
    return F.expr(f"aggregate({proof}, {leaf}, (x, s) -> sha2(concat(s.left, x, s.right), 256))")


def siblings(proof: str = "proof") -> Column:
    """All siblings of a proof, from the leaf's to the root's, left to right."""
    return F.expr(f"array_join(transform({proof}, s -> concat(s.left, s.right)), '')")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", more: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: tree, leaf, subroot, root, ``proof`` (array of left and right siblings) and ``more``, a
    struct of the columns to carry along."""
    columns = [F.col(tree).alias("tree"), F.col(key).alias("key"), digest(*(F.col(c) for c in fields)).alias("digest")]
    leaves = docs.select(*columns, (F.struct(key) if more is None else more).alias("more"))
    nodes = levels(ranked(leaves), fanout)
    # the trees' roots are the leaves of one tree more
    roots = tree_roots(nodes).select(F.lit(True).alias("tree"), F.col("tree").alias("key"), "digest", F.struct(F.col("tree").alias("name"), F.col("digest").alias("subroot")).alias("more"))
    upper = levels(ranked(roots), fanout)
    none = F.array().cast(_SIDES).alias("proof")
    root = tree_roots(upper).select("tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none)
    tops = proofs(handed_down(upper, root, fanout)).select(F.col("more.name").alias("tree"), "more.subroot", "root", "proof")
    return proofs(handed_down(nodes, stored(tops, "tops"), fanout))


def check_tampered(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` against rows of which a third was changed: where 3 divides crc32(doc_id), the text's A-Z are
    lower case (a null doc_id is never changed)."""
    changed = digest(*(F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS))
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, more=F.struct("doc_id", F.when(picked, changed).alias("tampered")))
    rows = rows.withColumn("now", F.coalesce("more.tampered", "leaf")).withColumn("folded_root", folded("now"))
    return rows.select("more.doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
