"""A Merkle manifest of a dataset as a postorder append log.

Leaves of one group (a source) ascend by key. While several nodes remain, every three consecutive ones
(the last run may be shorter) become the digest of their joined hex digests; what remains is the group's
subroot. The subroots are the leaves of one more tree, whose root stands for the dataset.

Trees are built in aligned segments of 3^7 leaves (a parameter): a segment is a whole subtree, so builders need
nothing of each other. A builder takes its leaves in order and appends every node at the moment it is
complete, which is postorder. Where a node stands follows from its level and index alone (the number of
nodes of each level that are complete by then), so children are found while building, and siblings while
extracting proofs, by address. Roots of segments are the leaves of the next stage until one is left.

Proofs come from the logs top down: a segment's rows get the path from its root to the dataset's root,
and add the part inside the segment. Texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.session import run_dir

ARITY = 3
LEVELS = 7  # of a segment: its 2,187 leaves are 3,280 nodes, about 105 kB of log
OWN = "."  # in a path entry: the place of the node itself among its siblings
SEGMENT = "tree string, segment long, n long, size long, keys array<string>, changed array<binary>, log binary, root binary"


def field(value: Column) -> Column:
    """``-`` for a null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def hashed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def complete(level: int, index: int, leaves: int, height: int) -> int:
    """Postorder place (from 0) of a node in a tree of ``leaves`` leaves and ``height`` levels above them.

    The node is complete with leaf ``last``. Up to then every level at or under its own has completed
    all nodes over leaves up to ``last``; higher levels only those that ended before it.
    """
    last = min((index + 1) * ARITY**level, leaves)
    under = sum(-(-last // ARITY**j) for j in range(level + 1))
    over = sum((last - 1) // ARITY**j for j in range(level + 1, height + 1))
    return under + over - 1


def places(level: int, leaves: int, height: int) -> np.ndarray:
    """:func:`complete` of all nodes of a level."""
    last = np.minimum((np.arange(-(-leaves // ARITY**level)) + 1) * ARITY**level, leaves)
    under = sum(-(-last // ARITY**j) for j in range(level + 1))
    return under + sum((last - 1) // ARITY**j for j in range(level + 1, height + 1)) - 1


def height_of(leaves: int, total: int, levels: int) -> int:
    """Levels of a segment: up to one node if it is a whole tree (of ``total`` leaves), else as many as all segments have."""
    if total > ARITY**levels:
        return levels
    height = 0
    while leaves > ARITY**height:
        height += 1
    return height


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """All nodes of a segment in completion order. Children are read back from the log by their places."""
    n, log = len(leaves), []
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        for level in range(1, height + 1):
            if (i + 1) % ARITY**level and i + 1 < n:
                break
            index = i // ARITY**level
            children = range(index * ARITY, min(index * ARITY + ARITY, -(-n // ARITY ** (level - 1))))
            log.append(hashed("".join(log[complete(level - 1, c, n, height)] for c in children).encode()))
    return log


def paths(log: Sequence[str], leaves: int, height: int) -> list[list[str]]:
    """Per leaf its way up: at each level the siblings left of the node, the mark, those right of it."""
    above: list[list[str]] = [[] for _ in range(-(-leaves // ARITY**height))]
    for level in range(height - 1, -1, -1):
        row = [log[p] for p in places(level, leaves, height).tolist()]
        down = []
        for i in range(len(row)):
            first = i - i % ARITY
            run = row[first: first + ARITY]
            run[i - first] = OWN
            down.append(["".join(run), *above[i // ARITY]])
        above = down
    return above


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for entry in path:
        leaf = hashed(entry.replace(OWN, leaf).encode())
    return leaf


def proof(path: Sequence[str]) -> str:
    """Digest of all siblings, level by level, left to right."""
    return hashed("".join(path).replace(OWN, "").encode())


def written(df: DataFrame, home: str) -> DataFrame:
    df.write.parquet(home)
    return df.sparkSession.read.parquet(home)


def ranked(leaves: DataFrame, home: str) -> DataFrame:
    """``tree, _rank, _leaves`` and the other columns: place of a leaf in its tree by (order, leaf), and the tree's size.

    Rows are range-partitioned and sorted, so a tree with most of the rows is many partitions. A row's
    place in its partition is its identifier; what earlier partitions hold of the tree is a running sum
    over one row per (tree, partition).
    """
    by = ["tree", "order", "leaf"]
    dealt = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = written(dealt.withColumn("_id", F.monotonically_increasing_id()), home)
    part = F.shiftright("_id", 33).alias("_part")
    blocks = numbered.groupBy("tree", part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("tree").alias("_t"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_from"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("_leaves"))
    met = numbered.join(starts, (F.col("tree") == F.col("_t")) & (F.shiftright("_id", 33) == F.col("_p")))
    return met.select("tree", "key", "leaf", "changed", (F.col("_id") + F.col("_from")).alias("_rank"), "_leaves")


def segments(leaves: DataFrame, levels: int) -> DataFrame:
    """Builds all segments of ranked leaves; one row each (``SEGMENT``), with the log as joined raw digests."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_rank")
        n, total = rows.num_rows, rows["_leaves"][0].as_py()
        height = height_of(n, total, levels)
        log = append_log(rows["leaf"].to_pylist(), height)
        changed = [bytes.fromhex(c) if c else None for c in rows["changed"].to_pylist()]
        return pa.table({
            "tree": rows["tree"].slice(0, 1), "segment": [key[1].as_py()], "n": [n], "size": [total],
            "keys": pa.array([rows["key"].to_pylist()], pa.list_(pa.string())), "changed": pa.array([changed], pa.list_(pa.binary())),
            "log": [bytes.fromhex("".join(log))], "root": [bytes.fromhex(log[-1])]})

    numbered = leaves.withColumn("_segment", F.expr(f"_rank div {ARITY**levels}"))
    return numbered.groupBy("tree", "_segment").applyInArrow(run, SEGMENT)


@dataclass
class Manifest:
    """Logs of all stages: those of the groups' trees first, then those of the tree over the groups."""

    groups: list[DataFrame]
    top: list[DataFrame]
    levels: int


def grown(leaves: DataFrame, home: str, levels: int) -> list[DataFrame]:
    """Stages of segments until every tree is one segment; each is stored."""
    span = ARITY**levels
    stages = [written(segments(ranked(leaves, f"{home}/rank-0"), levels), f"{home}/log-0")]
    while True:
        last = stages[-1]
        largest = last.agg(F.max("size")).first()[0] or 0
        if largest <= span:
            return stages
        # a tree that was one segment is done: its subroot goes on as a tree of one leaf
        up = last.select(
            "tree", F.col("segment").cast("string").alias("key"), F.lower(F.hex("root")).alias("leaf"), F.lit(None).cast("string").alias("changed"),
            F.col("segment").alias("_rank"), F.expr(f"(size + {span - 1}) div {span}").alias("_leaves"))
        stages.append(written(segments(up, levels), f"{home}/log-{len(stages)}"))


def nodes(stages: Sequence[DataFrame]) -> DataFrame:
    """The append log as a table: ``tree, stage, segment, place, digest`` (hex), a row per node."""
    out = None
    for i, stage in enumerate(stages):
        part = stage.select("tree", F.lit(i).alias("stage"), "segment", F.lower(F.hex("log")).alias("_log"), F.expr("octet_length(log) div 32").alias("_n"))
        part = part.select("tree", "stage", "segment", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("place"), "_log")
        part = part.withColumn("digest", F.expr("substring(_log, place * 64 + 1, 64)")).drop("_log")
        out = part if out is None else out.unionByName(part)
    return out


def leaves_of(docs: DataFrame, key: str, group: str, fields: Sequence[str], changed: Column | None, text: str | None) -> DataFrame:
    """``tree, order, key, leaf, changed``: digests of all rows, taken where they are read."""
    leaf = digest([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, digest([F.expr(f"replace(`{text}`, '\n', '')") if c == text else F.col(c) for c in fields]))
    name = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    return docs.select(
        name.alias("tree"), F.col(key).alias("order"), F.col(key).cast("string").alias("key"), leaf.alias("leaf"), other.alias("changed"))


def manifest(leaves: DataFrame, spark: SparkSession, levels: int = LEVELS) -> Manifest:
    """All logs, in a fresh folder of the shared one."""
    home = run_dir(spark, "manifest")
    groups = grown(leaves, f"{home}/groups", levels)
    roots = groups[-1].where("segment = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("order"), F.col("tree").alias("key"), F.lower(F.hex("root")).alias("leaf"),
        F.lit(None).cast("string").alias("changed"))
    return Manifest(groups, grown(roots, f"{home}/top", levels), levels)


def extracted(stage: DataFrame, upper: DataFrame, levels: int, last: bool = False) -> DataFrame:
    """Walks one stage down: per leaf ``tree, key, subroot, root, path``, or on the last stage the proof itself.

    ``upper`` has ``tree, segment, subroot, root, path`` per segment, the path being that of its root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "key", "leaf", "subroot", "root"]
        for b in batches:
            for i in range(b.num_rows):  # one segment at a time
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                raw = r["log"].hex()
                log = [raw[j: j + 64] for j in range(0, len(raw), 64)]
                n, above = r["n"], r["path"]
                height = height_of(n, r["size"], levels)
                here = [log[p] for p in places(0, n, height).tolist()]
                ways = [[*p, *above] for p in paths(log, n, height)]
                cols = [pa.array([r["tree"]] * n), pa.array(r["keys"], pa.string()), pa.array(here),
                        pa.array([r["subroot"]] * n), pa.array([r["root"]] * n)]
                if last:
                    lost = [folded(c.hex() if c else leaf, w) for leaf, c, w in zip(here, r["changed"], ways, strict=True)]
                    cols += [pa.array(map(proof, ways)), pa.array(lost)]
                    yield pa.RecordBatch.from_arrays(cols, [*names, "proof_sha256", "folded_root"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ways, pa.list_(pa.string()))], [*names, "path"])

    met = stage.drop("root").join(upper, ["tree", "segment"])
    rest = "proof_sha256 string, folded_root string" if last else "path array<string>"
    return met.mapInArrow(run, f"tree string, key string, leaf string, subroot string, root string, {rest}")


def proofs(made: Manifest) -> DataFrame:
    """``tree, key, leaf, subroot, root, proof_sha256, folded_root`` of every leaf, top down through the logs."""
    top = made.top[-1]
    upper = top.select("tree", "segment", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("root")).alias("root"),
                       F.array().cast("array<string>").alias("path"))
    for i, stage in enumerate(reversed(made.top)):
        down = extracted(stage, upper, made.levels)
        if i + 1 < len(made.top):  # leaves are segments of the stage below
            upper = down.select("tree", F.col("key").cast("long").alias("segment"), "subroot", "root", "path")
    # leaves of the top tree are the groups' subroots
    upper = down.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("segment"), F.col("leaf").alias("subroot"), "root", "path")
    for i, stage in enumerate(reversed(made.groups)):
        last = i + 1 == len(made.groups)
        down = extracted(stage, upper, made.levels, last)
        if not last:
            upper = down.select("tree", F.col("key").cast("long").alias("segment"), "subroot", "root", "path")
    return down


def verified(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, text: str = "text", levels: int = LEVELS,
) -> DataFrame:
    """``<key>, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Where ``tampered`` holds, the leaf is checked as if the line breaks of ``text`` were gone. A null group is a
    group of its own and comes first; null keys come first in theirs; rows of one key go by their leaf's
    digest, and rows that repeat are leaves of their own. Columns other than ``fields`` take no part; an
    empty table gives an empty result.
    """
    rows = leaves_of(docs.select(*dict.fromkeys((key, group, *fields))), key, group, fields, tampered, text)
    got = proofs(manifest(rows, docs.sparkSession, levels))
    return got.select(
        F.col("key").cast(docs.schema[key].dataType).alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
