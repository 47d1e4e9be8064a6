"""A Merkle manifest of a data set: digests of its rows, hashed up to one root, with a proof for every row.

Every language has a tree.  Its leaves are the rows by doc_id; runs of eight
nodes become one node until a single one, the subroot, is left.  The subroots,
by language, are the leaves of a last tree, whose root stands for all rows.

Nodes are kept in an append log in postorder, the order in which they are
complete.  Aligned builders, one for 8^HEIGHT neighbouring leaves, write their
part of the log on their own: where a node lies follows in closed form from the
sizes of the full subtrees before it, so a proof finds the siblings of a path by
their positions.

Rows of one doc_id and language are ordered by their digests; equal rows have
leaves of their own.  A null id is first and is never tampered with; a null
language is a tree of its own before all others; any null field is written `-`.
A table without rows has no tree and gives no rows.  Further columns of the
input are not read, whatever their names.  The length of a text matters to its
own row alone.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.shared import documents, write_table

FAN, BITS = 8, 3
HEIGHT = 4  # levels that a builder closes: 4,096 leaves
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TAMPERED_ONE_IN = 3


# closed form


def position(level: int, index: int, n: int) -> int:
    """Where node `index` of a level lies in the log of a tree with n leaves.

    It is complete once its last leaf is; before that leaf lie all leaves to
    its left and the nodes they have closed, one for each full subtree.
    """
    last = min((index + 1) << (BITS * level), n) - 1
    at, below = level, last
    while below:
        at += below
        below >>= BITS
    return at


def width(level: int, n: int) -> int:
    """How many nodes a level has over n leaves."""
    return ((n - 1) >> (BITS * level)) + 1


def _position(level: Column, index: Column, n: Column) -> Column:
    """position() as an expression."""
    last = F.least(F.call_function("shiftleft", index + 1, BITS * level), n) - 1
    return sum((F.shiftright(last, BITS * m) for m in range(1, 21)), last + level)


# rows and leaves


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(text: Column) -> Column:
    """The leaf of a row with columns doc_id, source, lang, n_chars and this text, as 32 bytes."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and `altered`: the digest after tampering, null where there is none."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0
    own = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), digest(F.col("text")).alias("digest"), F.when(tampered, digest(F.translate("text", UPPER, UPPER.lower()))).alias("altered"))
    return own.select("tree", "doc_id", "digest", "altered")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `index`, their number in their tree, and `n`, the tree's leaves.

    Rows are sorted over all tasks, so that a large tree has many; a tree's first
    number in a task is the sum of what earlier tasks hold of it.
    """
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed, _ = write_table(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), "placed")
    held = placed.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("tree", "task", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n"))
    return placed.join(offsets, ["tree", "task"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "task", "shift")


# builders


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def closed(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels over the neighbouring nodes of one builder, of n on their level: `height` of them, or fewer up to the root."""
    levels = [nodes]
    while len(levels) <= height and (n > 1 << (BITS * height) or len(levels[-1]) > 1):
        levels.append([_hash(levels[-1][k : k + FAN]) for k in range(0, len(levels[-1]), FAN)])
    return levels


def _segment(height: int, table: pa.Table) -> pa.Table:
    """One builder's part of the log, in postorder, with what its leaves carry."""
    table = table.sort_by("index")
    n, own = table.column("n")[0].as_py(), [d.hex() for d in table.column("digest").to_pylist()]
    levels = closed(own, n, height)
    log = [b""] * sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for k, node in enumerate(nodes):
            log[position(level, k, len(own))] = bytes.fromhex(node)
    carried = {c: pa.array([table.column(c).combine_chunks().to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("doc_id", "altered")}
    tree, block = table.column("tree")[0].as_py(), table.column("index")[0].as_py() >> (BITS * height)
    return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()), "nodes": pa.array([b"".join(log)], pa.binary()), **carried})


def _upper(level: int, height: int, table: pa.Table) -> pa.Table:
    """Nodes over the roots of lower builders: (tree, n, position, level, index, digest)."""
    table = table.sort_by("index")
    first, n, tree = table.column("index")[0].as_py(), table.column("n")[0].as_py(), table.column("tree")[0].as_py()
    out = []
    levels = closed([d.hex() for d in table.column("digest").to_pylist()], width(level, n), height)
    for up, nodes in enumerate(levels):
        for k, node in enumerate(nodes):
            index = (first >> (BITS * up)) + k
            out.append((tree, n, position(level + up, index, n), level + up, index, bytes.fromhex(node)))
    names = ("tree", "n", "position", "level", "index", "digest")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({name: pa.array(x, kind) for name, x, kind in zip(names, zip(*out, strict=True), kinds, strict=True)})


def build(rows: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The log over numbered rows (tree, index, n, digest, doc_id, altered): the builders' segments, and the single nodes from their roots on."""
    kind = dict(rows.dtypes)["doc_id"]
    block = rows.withColumn("block", F.shiftright("index", BITS * height)).select("tree", "block", "index", "n", "digest", "doc_id", "altered")
    schema = f"tree string, block long, n long, nodes binary, doc_id array<{kind}>, altered array<binary>"
    segments, _ = write_table(block.groupBy("tree", "block").applyInArrow(lambda t: _segment(height, t), schema), "segments")
    nodes = segments.select("tree", "n", F.col("block").alias("index"), F.expr("substring(nodes, -32, 32)").alias("digest"))
    most, level, made = segments.agg(F.max("n")).first()[0] or 0, height, []
    schema = "tree string, n long, position long, level int, index long, digest binary"
    if most <= 1 << (BITS * height):
        root = segments.select("tree", "n", F.lit(0).cast("long").alias("position"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("index"), F.expr("substring(nodes, -32, 32)").alias("digest"))
        return segments, root
    while True:  # a round closes `height` levels: three rounds hold 6 * 10^10 leaves
        dealt = nodes.withColumn("block", F.shiftright("index", BITS * height))
        grown, _ = write_table(dealt.groupBy("tree", "block").applyInArrow(lambda t: _upper(level, height, t), schema), "nodes")
        made.append(grown if not made else grown.filter(F.col("level") > level))
        if width(level + height, most) == 1:
            break
        level += height
        nodes = grown.filter((F.col("level") == level)).select("tree", "n", "index", "digest")
    upper = made[0]
    for more in made[1:]:
        upper = upper.unionByName(more)
    return segments, upper


def roots(upper: DataFrame) -> DataFrame:
    """tree, root: the last node of each log."""
    return upper.groupBy("tree").agg(F.max_by("digest", "level").alias("root"))


# proofs

STEPS = "array<struct<left:string,right:string>>"


def upper_paths(segments: DataFrame, upper: DataFrame, height: int = HEIGHT) -> DataFrame:
    """tree, block, shown: the siblings of each builder's path to the root of its tree, found by their positions in the log."""
    levels = F.expr(f"filter(sequence({height}, 20), h -> shiftright(n - 1, {BITS} * h) > 0)")
    path = segments.select("tree", "block", "n", F.explode(levels).alias("level"))
    own = path.withColumn("own", F.call_function("shiftright", "block", BITS * (F.col("level") - height)))
    first = F.shiftright("own", BITS) * FAN
    last = F.least(first + FAN - 1, F.call_function("shiftright", F.col("n") - 1, BITS * F.col("level")))
    sought = own.select("tree", "block", "n", "level", "own", F.explode(F.sequence(first, last)).alias("index")).filter("index <> own")
    at = sought.select("tree", "block", "level", "own", "index", _position(F.col("level"), F.col("index"), F.col("n")).alias("position"))
    met = at.join(upper.select("tree", "position", "digest"), ["tree", "position"])
    one = F.struct("level", "index", "own", F.lower(F.hex("digest")).alias("digest"))
    found = met.groupBy("tree", "block").agg(F.array_sort(F.collect_list(one)).alias("found"))

    side = lambda h, left: F.array_join(F.transform(F.filter("found", lambda s: (s["level"] == h) & ((s["index"] < s["own"]) if left else (s["index"] > s["own"]))), lambda s: s["digest"]), "")
    steps = F.transform(levels, lambda h: F.struct(side(h, True).alias("left"), side(h, False).alias("right")))
    return segments.select("tree", "block", "n").join(found, ["tree", "block"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<level:int,index:bigint,own:bigint,digest:string>>"))).select(F.col("tree").alias("tree"), F.col("block").alias("block"), steps.cast(STEPS).alias("shown"))


def _sides(nodes: bytes, m: int, n: int, height: int) -> list[list[tuple[str, str]]]:
    """For each level of a builder with m leaves and each node on it: the siblings to its left and right, read from the log by position."""
    out, count = [], m
    while len(out) < height and (n > 1 << (BITS * height) or count > 1):
        level = len(out)
        at = [32 * position(level, k, m) for k in range(count)]
        own = [nodes[a : a + 32].hex() for a in at]
        out.append([("".join(own[k // FAN * FAN : k]), "".join(own[k + 1 : k // FAN * FAN + FAN])) for k in range(count)])
        count = width(1, count)
    return out


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        leaf = _hash([left, leaf, right])
    return leaf


def _paths(height: int, segment: pa.Table, shared: pa.Table) -> pa.Table:
    """(doc_id, leaf, steps, root) of every leaf of a builder."""
    ids, sides, nodes, m, above, kind = _opened(height, segment, shared)
    steps = [[sides[h][k >> (BITS * h)] for h in range(len(sides))] + above for k in range(m)]
    own = [nodes[32 * position(0, k, m) :][:32].hex() for k in range(m)]
    shown = pa.array([[{"left": a, "right": b} for a, b in s] for s in steps], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
    return pa.table({"doc_id": pa.array(ids, kind), "leaf": own, "steps": shown, "root": [folded(d, s) for d, s in zip(own, steps, strict=True)]})


def _opened(height: int, segment: pa.Table, shared: pa.Table) -> tuple:
    row = segment.to_pylist()[0]
    m = len(row["doc_id"])
    above = [(s["left"], s["right"]) for s in shared.column("shown")[0].as_py()]
    return row["doc_id"], _sides(row["nodes"], m, row["n"], height), row["nodes"], m, above, segment.schema.field("doc_id").type.value_type


def _proofs(height: int, segment: pa.Table, shared: pa.Table) -> pa.Table:
    ids, sides, nodes, m, above, kind = _opened(height, segment, shared)
    altered, root, subroot = (x.column(c)[0].as_py() for x, c in ((segment, "altered"), (shared, "root"), (shared, "subroot")))
    common, out = "".join(a + b for a, b in above), {"leaf": [], "proof_sha256": [], "folded_root": []}
    for k in range(m):
        leaf = nodes[32 * position(0, k, m) :][:32].hex()
        steps = [sides[h][k >> (BITS * h)] for h in range(len(sides))]
        out["leaf"].append(leaf)
        out["proof_sha256"].append(_hash([x for pair in steps for x in pair] + [common]))
        out["folded_root"].append(folded(altered[k].hex() if altered[k] is not None else leaf, steps + above))
    return pa.table({
        "doc_id": pa.array(ids, kind), "leaf": out["leaf"], "subroot": [subroot] * m, "root": [root] * m,
        "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"], "verified": [f == root for f in out["folded_root"]],
    })


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    proof_sha256 digests the siblings on the way to the root; folded_root is
    recomputed from them and the leaf, the tampered one where there is one.
    """
    kind = docs.select("doc_id").dtypes[0][1]
    own, _ = write_table(leaves(docs), "leaves")
    segments, upper = build(numbered(own, "doc_id", "digest"), height)
    # the last tree: one leaf for each language
    names = roots(upper).select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("altered"))
    over, last = build(numbered(names, "doc_id"), height)
    key = ["tree", "block"]
    onward = over.groupBy(*key).cogroup(upper_paths(over, last, height).groupBy(*key)).applyInArrow(lambda a, b: _paths(height, a, b), f"doc_id string, leaf string, steps {STEPS}, root string")
    top, _ = write_table(onward.select(F.col("doc_id").alias("tree"), F.col("leaf").alias("subroot"), "steps", "root"), "subroots")
    shared = upper_paths(segments, upper, height).join(top, "tree").select(*key, F.concat("shown", "steps").alias("shown"), "subroot", "root")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return segments.groupBy(*key).cogroup(shared.groupBy(*key)).applyInArrow(lambda a, b: _proofs(height, a, b), schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it verifies after tampering."""
    return manifest(documents(spark, sf_dir))
