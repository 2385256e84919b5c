"""Merkle manifest of a dataset: a digest of every row, of every group of rows and of the whole, with proofs.

A row's leaf hashes its fields. The leaves of a group stand in the order of their ids; every FAN in a row
become the hash of their hex digests, level by level, until one is left, and the groups' last nodes, in the
order of their names, are put together the same way. On each level lag and lead columns of fixed offsets, kept
where the place in the run and the length of the run have such a neighbour, give a node's siblings; the first
row of a run has all of it and hashes the parent. On the way down every node gets the siblings above it from
its parent, so a leaf's proof is there without the tree being looked through leaf by leaf.

A window is one run, FAN rows at most, however large a group is. Rows get their places in a group from a sort by
ranges, whose parts are counted: no group passes one task. Leaves are written before they are sorted, so a lost
executor changes no place.

Null fields have a mark of their own in the leaf. Rows without an id come first in their group, the group
without a name first of all. Rows with the same id stand in the order of their leaves; equal rows are
interchangeable and keep a row each. Empty texts and texts of any length are fields like others. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from panewise.llm.common import Scratch

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Rows of the table of places that is sent to every executor; a larger one is joined by a shuffle.
SENT_ROWS = 100_000
#: Bits of a row's number within its part of a sorted table, as Spark numbers rows.
_PART_BITS = 33
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: the SHA-256 of the parts put together, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(node: Column) -> Column:
    """A digest as it goes into hashes: lower-case hex; nothing for a null."""
    return F.coalesce(F.lower(F.hex(node)), F.lit(""))


def leaf(fields: list[Column]) -> Column:
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(one, fields))


def tampered(id: Column, every: int = 5) -> Column:
    """Whether a row is one of those that are changed on purpose."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % every == 0, F.lit(False))


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with `at`, the place in their group by `order` from 0, and `of`, the rows of the group.

    Ties in the order are broken by any one number per row.
    """
    numbered = scratch.write(rows).withColumn("__tie", F.monotonically_increasing_id())
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    in_order = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    in_order = scratch.write(in_order.withColumn("__no", F.monotonically_increasing_id()))
    part = F.shiftright("__no", _PART_BITS)
    # A group has one stretch in each part, and at most one more for each part it reaches into.
    spans = in_order.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(
        F.min("__no").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy("__group").orderBy("__part")
    spans = spans.select(
        "__group", "__part", "__first", (F.sum("__n").over(before) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__group")).alias("of"),
    )
    spans = scratch.write(spans)
    if spans.count() <= SENT_ROWS:
        spans = F.broadcast(spans)
    joined = in_order.withColumn("__part", part).join(spans.withColumnRenamed("__part", "__span"), (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__span")))
    at = F.col("__before") + F.col("__no") - F.col("__first")
    return joined.select(*rows.columns, at.alias("at"), "of")


# One level ------------------------------------------------------------------------------------------


def _neighbours(nodes: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
    """The nodes (g, at, of, node) with `run`, and the siblings of each before and after it, as hex or ''."""
    run = F.floor(F.col("at") / FAN)
    rows = nodes.withColumn("run", run)
    window = Window.partitionBy("g", "run").orderBy("at")
    slot = F.col("at") % FAN
    length = F.least(F.lit(FAN), F.col("of") - F.col("run") * FAN)
    lags = [shown(F.when(slot >= o, F.lag("node", o).over(window))) for o in range(FAN - 1, 0, -1)]
    leads = [shown(F.when(slot + o < length, F.lead("node", o).over(window))) for o in range(1, FAN)]
    return rows, lags, leads


def parents(nodes: DataFrame) -> DataFrame:
    """The level above of all groups with more than one node."""
    rows, _, leads = _neighbours(nodes.filter("of > 1"))
    made = rows.select("g", "run", "of", (F.col("at") % FAN).alias("slot"), digest(shown(F.col("node")), *leads).alias("node"))
    above = F.floor((F.col("of") + FAN - 1) / FAN)
    return made.filter("slot = 0").select("g", F.col("run").alias("at"), above.alias("of"), "node")


def siblings(nodes: DataFrame, *columns: str) -> DataFrame:
    """`g, at, run, step` of all nodes in groups with more than one, step = (left, right)."""
    rows, lags, leads = _neighbours(nodes.filter("of > 1"))
    step = F.struct(F.concat(*lags).alias("left"), F.concat(*leads).alias("right"))
    return rows.select("g", "at", "run", *columns, step.alias("step"))


@dataclass(frozen=True)
class Tree:
    """The levels (g, at, of, node) of all groups from the leaves up, and `tops` (g, node)."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, scratch: Scratch) -> Tree:
    """All levels; each is written, a FAN-th of the one below it. The driver learns the largest group's size."""
    most = leaves.agg(F.max("of")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        levels.append(scratch.write(parents(levels[-1])))
        most = -(-most // FAN)
    alone = [level.filter("of = 1").select("g", "node") for level in levels]
    return Tree(levels, reduce(DataFrame.unionByName, alone))


def paths(tree: Tree, scratch: Scratch, above: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """`g, at, top, path` of the leaves with their `columns`: the last node of the group, and the siblings (left,
    right) of each level, lowest first, followed by what `above` (g, path) has for the group.

    The join to the level above goes by the run that the window was dealt by, so siblings aren't shuffled.
    """

    def topped(rows: DataFrame, *names: str) -> DataFrame:
        held = rows.withColumn("path", F.array().cast(_PATH)) if above is None else rows.join(above, "g")
        return held.select("g", "at", *names, F.col("node").alias("top"), "path")

    upper: DataFrame | None = None
    for number, level in reversed(list(enumerate(tree.levels))):
        names = columns if number == 0 else ()
        own = topped(level.filter("of = 1"), *names)
        if upper is not None:
            higher = upper.select("g", F.col("at").alias("run"), "top", F.col("path").alias("higher"))
            found = siblings(level, *names).join(higher, ["g", "run"])
            path = F.concat(F.array("step"), "higher").alias("path")
            own = own.unionByName(found.select("g", "at", *names, "top", path))
        upper = scratch.write(own) if number else own
    return upper


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, as lower-case hex."""
    up = lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256)
    return F.aggregate(path, shown(node), up)


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """A row per document: `id, leaf, subroot, root, proof_sha256, folded_root, verified`, digests as lower-case hex.

    Rows that `tampered` picks are folded from the leaf of their changed text, A-Z as a-z. The texts are read
    once and never shuffled; what is, are digests of 32 bytes.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    other = F.translate(F.col(text), ascii_uppercase, ascii_lowercase)
    changed = leaf([other if f == text else F.col(f) for f in fields])
    # A group's name in its order: the one without comes first.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(
        name.alias("g"),
        F.col(id).alias("id"),
        leaf([F.col(f) for f in fields]).alias("node"),
        F.when(tampered(F.col(id)), changed).alias("other"),
    )
    leaves = scratch.write(placed(rows, "g", ["id", "node"], scratch))
    tree = grow(leaves, scratch)
    tops = scratch.write(tree.tops)

    # The groups' last nodes are the leaves of one more tree.
    one = tops.select(F.lit("all").alias("all"), F.col("g").alias("name"), "node")
    one = scratch.write(placed(one, "all", ["name"], scratch).withColumnRenamed("all", "g"))
    whole = grow(one, scratch)
    over = paths(whole, scratch, columns=("name",)).select(F.col("name").alias("g"), "path")
    over = scratch.write(over)
    root = shown(whole.tops.select("node").scalar())

    told = paths(tree, scratch, over, ("id", "node", "other"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    up = told.withColumn("folded_root", folded(F.coalesce("other", "node"), F.col("path")))
    return up.select(
        F.col("id").alias(id),
        shown(F.col("node")).alias("leaf"),
        shown(F.col("top")).alias("subroot"),
        root.alias("root"),
        proof.alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
