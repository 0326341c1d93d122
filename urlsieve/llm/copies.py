"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash proposes, the shingle sets decide. Every distinct shingle set gets 256 fingerprint bits. Two sets
are candidates if no more than 22 of the first 64 bits and 72 of all bits differ and their sizes allow the
similarity; all pairs of sets are compared, tile by tile. A tile returns a spanning forest, so a group of
n near copies sends n rows. Inside the classes of that forest every candidate pair that is not linked yet
is confirmed by the exact similarity of the two whole texts. Classes too large for a task are cut into
blocks, and blocks meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.simhash import SEED, _bit_counts, components, local_forest, one_per_root
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
NEAR_64, NEAR_256 = 22, 72
BITS = ("_f0", "_f1", "_f2", "_f3")
BLOCK = 1024
UNIT = 1 << 21  # shingles in a block of texts, 16 MB
_MIX = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; one for all words of a shorter text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends[shingle - 1:].tolist() or ends[-1:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, last)], dtype=np.uint64))


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def bits_of(found: np.ndarray) -> list[int]:
    """Four SimHash words of a shingle set, as signed longs."""
    out = []
    for salt in _MIX:
        h = found
        if salt:  # splitmix64
            h = h + np.uint64(salt)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        bits = np.flatnonzero(2 * _bit_counts(h) > len(h))
        out.append(sum(1 << int(b) for b in bits))
    return np.array(out, np.uint64).astype(np.int64).tolist()


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``_key, _set, _n, _f0 .. _f3, _text_id`` per row: id and size of the shingle set, fingerprint words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, words = [], [], []
            for t in b.column(1).to_pylist():
                found = shingles(t, shingle)
                ids.append(set_id(found))
                sizes.append(len(found))
                words.append(bits_of(found))
            w = np.array(words, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(w[:, i]) for i in range(4)), b.column(2)],
                ["_key", "_set", "_n", *BITS, "_text_id"])

    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_text_id"))
    return slim.mapInArrow(run, "_key long, _set long, _n long, " + ", ".join(f"{f} long" for f in BITS) + ", _text_id long")


def tile_candidates(
    a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all candidate pairs of a x b; each side is (ids, sizes, n x 4 words)."""
    (ia, na, fa), (ib, nb, fb) = (tuple(x[np.argsort(s[1], kind="stable")] for x in s) for s in (a, b))
    left, right, held = [], [], 0
    for at in range(0, len(ia), BLOCK):
        to = min(at + BLOCK, len(ia))
        lo = np.searchsorted(nb, similarity * na[at] - 1e-6)
        hi = np.searchsorted(nb, na[to - 1] / similarity + 1e-6, side="right")
        for low in range(lo, hi, 4 * BLOCK):
            high = min(hi, low + 4 * BLOCK)
            i, j = np.nonzero(np.bitwise_count(fa[at:to, None, 0] ^ fb[None, low:high, 0]) <= NEAR_64)
            i, j = i + at, j + low
            fits = (np.minimum(na[i], nb[j]) >= similarity * np.maximum(na[i], nb[j]) - 1e-6) & (ia[i] != ib[j])
            i, j = i[fits], j[fits]
            near = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int64) <= NEAR_256
            if near.any():
                left.append(ia[i[near]])
                right.append(ib[j[near]])
                held += len(left[-1])
                if held > 1 << 20:  # keep the forest, forget the pairs
                    f, g = local_forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [f], [g], len(f)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return local_forest(np.concatenate(left), np.concatenate(right))


def candidate_links(sets: DataFrame, similarity: float, groups: int = 8, most: int = 1 << 18) -> DataFrame:
    """``a, b``: forest edges whose classes are those of all candidate pairs of ``sets``."""
    n = max(groups, math.ceil(sets.count() / most))
    pairs = [(s, t) for s in range(n) for t in range(s, n)]
    plan = sets.sparkSession.createDataFrame(
        [(s, i, 0) for i, (s, _) in enumerate(pairs)] + [(t, i, 1) for i, (s, t) in enumerate(pairs) if s != t],
        "_tile int, _pair int, _side int")
    dealt = sets.withColumn("_tile", F.pmod(F.xxhash64("_set"), F.lit(n)).cast("int")).join(F.broadcast(plan), "_tile")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["_side"].to_numpy()

        def take(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            part = rows[which]
            return part["_set"].to_numpy(), part["_n"].to_numpy(), part[list(BITS)].to_numpy().astype(np.uint64)

        x, y = tile_candidates(take(side == 0), take(side == 1) if (side == 1).any() else take(side == 0), similarity)
        return pd.DataFrame({"a": x.astype(np.int64), "b": y.astype(np.int64)})

    tasks = min(4000, max(len(pairs), sets.sparkSession.sparkContext.defaultParallelism))
    return dealt.select("_pair", "_side", "_set", "_n", *BITS).repartition(tasks, "_pair").groupBy("_pair").applyInPandas(
        compare, "a long, b long")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Exact Jaccard similarity of two sorted sets against the bound; two empty sets are alike."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def confirmed(g: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links of a unit: candidate pairs of its two blocks with the similarity, unless linked before."""
    ids, n = g["_set"].to_numpy(), g["_n"].to_numpy()
    f = g[list(BITS)].to_numpy().astype(np.uint64)
    found = [np.frombuffer(x, np.uint64) for x in g["_shingles"]]
    side = g["_side"].to_numpy()
    two = bool((side == 1).any())
    label, edges = np.arange(len(ids)), []
    for i in range(len(ids)):
        if two and side[i] == 0:
            continue
        fits = (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-6) & (label != label[i])
        if two:
            fits &= side == 0
        else:
            fits[i:] = False
        j = np.flatnonzero(fits)
        j = j[np.bitwise_count(f[j] ^ f[i]).sum(axis=1, dtype=np.int64) <= NEAR_256]
        while len(j):
            first, j = j[0], j[1:]
            if alike(found[i], found[first], similarity):
                edges.append((ids[i], ids[first]))
                label[label == label[first]] = label[i]
                j = j[label[j] != label[i]]
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def confirmed_links(docs: DataFrame, members: DataFrame, key: str, text: str, similarity: float, shingle: int) -> DataFrame:
    """``a, b``: links of ``members`` (_set, _n, words, _least, _root) whose classes are those of all similar candidates."""
    wanted = members.groupBy("_least").agg(F.collect_set("_set").alias("_sets"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_least"), F.col(text).alias("_text"))
    chosen = lookup_join(rows, wanted, "_least").where(F.col("_sets").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kept = [], []
            for t, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shingles(t, shingle)
                if set_id(found) in sets:
                    ids.append(set_id(found))
                    kept.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["_set", "_shingles"])

    texts = chosen.select("_text", "_sets").mapInArrow(run, "_set long, _shingles binary").dropDuplicates(["_set"])
    weight = F.sum(F.col("_n") + 256)  # short texts count, so that a unit holds at most 8192 of them
    sizes = members.groupBy("_root").agg(F.ceil(weight / UNIT).cast("int").alias("_blocks"))
    bundles = max(1, math.ceil((members.agg(weight).first()[0] or 0) / UNIT))
    # small classes share a unit; a large one is cut into blocks, and all pairs of its blocks are units
    small = F.col("_blocks") <= 1
    cut = members.select("_set", "_n", *BITS, "_root").join(sizes, "_root").join(texts, "_set").select(
        "_set", "_n", *BITS, "_shingles", "_blocks",
        F.when(small, F.pmod(F.xxhash64("_root"), F.lit(bundles))).otherwise(F.col("_root")).alias("_unit"),
        F.pmod(F.xxhash64("_set"), F.col("_blocks")).cast("int").alias("_mine"), small.alias("_small"))
    units = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_set", "_n", *BITS, "_shingles", "_unit", "_small", F.least("_mine", "_other").alias("_i"),
        F.greatest("_mine", "_other").alias("_j"), (F.col("_mine") > F.col("_other")).cast("int").alias("_side"))
    return units.groupBy("_unit", "_small", "_i", "_j").applyInPandas(lambda g: confirmed(g, similarity), "a long, b long")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE,
) -> DataFrame:
    """``<key>, component_id`` for every row of ``docs`` with a key.

    ``component_id`` is the smallest key reachable over texts whose shingle sets are similar enough.
    Null and blank texts have an empty set and link with each other. Repeated rows stay; an empty table
    gives an empty result.
    """
    return classified(docs, key, text, similarity, shingle).select(F.col("_key").alias(key), "component_id")


def classified(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``_key, _text_id, _root, component_id`` for every row with a key; ``_root`` numbers the class."""
    rows = cut_lineage(sketches(docs, key, text, shingle))
    sets = cut_lineage(rows.groupBy("_set").agg(
        F.min("_key").alias("_least"), F.first("_n").alias("_n"), *(F.first(f).alias(f) for f in BITS)))
    near = components(candidate_links(sets.select("_set", "_n", *BITS), similarity))
    # components lists every node but the smallest of its class
    named = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = cut_lineage(sets.join(named.select(F.col("node").alias("_set"), F.col("root").alias("_root")), "_set"))
    roots = components(confirmed_links(docs, members, key, text, similarity, shingle))
    named = sets.select("_set", "_least").join(roots.withColumnRenamed("node", "_set"), "_set", "left").select(
        "_set", "_least", F.coalesce("root", "_set").alias("_root"))
    classes = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    table = named.select("_set", "_root").join(classes, "_root").select("_set", "_root", "component_id")
    return rows.select("_key", "_set", "_text_id").join(table, "_set").select("_key", "_text_id", "_root", "component_id")


def one_per_copy(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, one for each class of near copies; see ``simhash.one_per_root`` for ties."""
    return one_per_root(docs, classified(docs, key, text, **how), key, text)
