"""Merkle manifest of a dataset: a hash tree over each group's rows, and a tree over the groups' roots.

H is the SHA-256 of its inputs concatenated, digests as lower-case hex. Rows of a group in the order of their
ids are the leaves; `arity` consecutive nodes become their H, the last run of a level even if it has fewer, or
one; until one node is left, the group's root. A lone leaf is its group's root itself. The groups' roots, in the
order of their names, are the leaves of the tree above.

Blocks of arity ** height consecutive leaves are one row each. A block holds a level of its subtree as one
string of hex digests: substrings of a fixed width are hashed to the level above, and the substrings on either
side of a node within its run are its siblings there. The roots of the blocks are the leaves of the next round,
so a group of any size takes a few rounds, and no row holds more than a block. A group that fits a block is
climbed to its one node, a block of a larger group by `height` levels, even if it is the last and has one leaf.
Paths come down the rounds by block: a row carries only what lies above its block until it is given out.

Fields that are null count as `-`. A null group is a group of its own and comes first. Ids that repeat are ordered by
their leaves, null ids come first; rows equal in all fields are leaves side by side. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import numbered, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields, each as its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def levels(small: str, arity: int, height: int) -> Column:
    """The levels of a block from its leaves' digests in `level` to its root, each as one string."""
    last = "element_at(acc, -1)"
    up = f"array_join(transform(sequence(0, (length({last}) - 1) div {64 * arity}), j -> sha2(substring(cast({last} as binary), j * {64 * arity} + 1, {64 * arity}), 256)), '')"
    return F.expr(f"aggregate(sequence(1, {height}), array(level), (acc, i) -> if({small} and length({last}) <= 64, acc, concat(acc, array({up}))))")


def segment(arity: int) -> Column:
    """The siblings of the node at `place` of a block on each of its `levels`, left and right of it in its run."""
    at = f"(place div cast(pow({arity}, i) as int))"
    first = f"({at} div {arity} * {arity})"
    cut = lambda a, n: f"cast(substring(cast(s as binary), 64 * {a} + 1, 64 * {n}) as string)"
    left, right = cut(first, f"({at} - {first})"), cut(f"({at} + 1)", f"({arity - 1} - {at} + {first})")
    return F.expr(f"transform(slice(levels, 1, size(levels) - 1), (s, i) -> struct({left} as left, {right} as right))")


def fold(leaf: str, path: str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.expr(f"aggregate({path}, {leaf}, (acc, s) -> sha2(concat(s.left, acc, s.right), 256))")


class Tree:
    """The tree of each group `g` over its rows (g, at, of, node, row): `roots` has (g, root)."""

    def __init__(self, rows: DataFrame, arity: int, height: int, label: str):
        self.arity, self.height, self.label = arity, height, label
        size = self.size = arity**height
        self.rounds: list[DataFrame] = []
        while True:
            members = F.array_sort(F.collect_list(F.struct("at", "node", "row")))
            blocks = rows.groupBy("g", F.expr(f"at div {size}").alias("block")).agg(F.max("of").alias("of"), members.alias("members"))
            blocks = blocks.withColumn("level", F.array_join(F.transform("members", lambda m: F.lower(F.hex(m["node"]))), ""))
            self.rounds.append(stored(blocks, f"{label}-blocks"))
            root = F.unhex(F.element_at(self._levels(), -1))
            up = self.rounds[-1].select("g", F.col("block").alias("at"), F.expr(f"cast(ceil(of / {size}D) as bigint)").alias("of"), root.alias("node"), F.lit(None).cast("int").alias("row"))
            rows = stored(up, f"{label}-roots")
            if (rows.agg(F.max("of")).first()[0] or 1) == 1:
                break
        self.roots = rows.select("g", F.lower(F.hex("node")).alias("root"))

    def _levels(self) -> Column:
        return levels(f"of <= {self.size}", self.arity, self.height)

    def paths(self, above: DataFrame) -> DataFrame:
        """(row, leaf, path, and the other columns of `above`) of every leaf; `above` has (g, path) of each group's root."""
        others = [c for c in above.columns if c not in ("g", "path")]
        down = above.withColumn("at", F.lit(0).cast("long"))
        for i in reversed(range(len(self.rounds))):
            upper = down.select(F.col("g").alias("u_g"), F.col("at").alias("u_at"), F.col("path").alias("above"), *others)
            blocks = self.rounds[i].join(upper, (F.col("g") == F.col("u_g")) & (F.col("block") == F.col("u_at"))).withColumn("levels", self._levels())
            each = blocks.select("g", "block", "levels", "above", *others, F.posexplode("members").alias("place", "member"))
            path = F.concat(segment(self.arity), F.col("above"))
            down = each.select("g", (F.col("block") * self.size + F.col("place")).alias("at"), path.alias("path"), F.col("member.node").alias("node"), F.col("member.row").alias("row"), *others)
        return down.select("row", F.lower(F.hex("node")).alias("leaf"), "path", *others)


def manifest(docs: DataFrame, suspect: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", arity: int = 2, height: int = 8) -> DataFrame:
    """One row per document: id, leaf, subroot, root, path, folded_root, verified.

    path: what stands left and right of the node on each level up to the root. folded_root: the root that the path
    gives for the row as it is now, with the columns of `suspect` in place of those of the manifest; verified: it is
    the root. height: levels of a block."""
    now = leaf_of([(suspect or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), F.col(id_col).alias("id"), leaf_of([F.col(f) for f in fields]).alias("leaf"), now.alias("now"))
    rows = rows.select("g", "id", F.unhex("leaf").alias("node"), F.when(F.col("now") != F.col("leaf"), F.unhex("now")).alias("now"))
    rows = numbered(rows, [F.col("id").asc_nulls_first(), F.col("node")], "g", "manifest-leaves")
    groups = Tree(rows.select("g", "at", "of", "node", F.struct("id", "now").alias("row")), arity, height, "manifest")
    names = numbered(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.unhex("root").alias("node")), [F.col("name")], "g", "manifest-groups")
    top = Tree(names.select("g", "at", "of", "node", F.col("name").alias("row")), arity, height, "manifest-top")
    upper = top.paths(top.roots.withColumn("path", F.array().cast(PATH)))
    upper = stored(upper.select(F.col("row").alias("g"), F.col("leaf").alias("subroot"), "root", "path"), "manifest-upper")
    out = groups.paths(upper).withColumn("now", F.coalesce(F.lower(F.hex("row.now")), F.col("leaf")))
    out = out.withColumn("folded_root", fold("now", "path"))
    return out.select(F.col("row.id").alias(id_col), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
