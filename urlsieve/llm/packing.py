"""Packing token sequences by cutting-stock column generation.

Every document gives whole sequences of ``capacity`` tokens and one rest. The rests are counted in a
length histogram of fixed size (``bins``), and the driver solves the cutting-stock linear program over
patterns of bins: a knapsack dynamic programme prices new patterns against the dual prices until none
improves. Rounded-down patterns plus first-fit patterns for what rounding left are numbered, the rests
of each bin are ranked, and rank r of a bin takes the r-th slot of that bin: a join on (bin, slot).

Bins round lengths up, so packed sequences keep small gaps. One rest in ``1/filler_share`` (by hash of the
key) is held back: these fillers form one stream that is cut to close the gaps exactly and then fills
further sequences; the last of them is cut into powers of two, which need no padding. Cuts of fillers
are the only cuts besides those of whole sequences.

Nothing that grows with the corpus passes through the driver or one task: ranks and running totals are
taken per hash bucket with offsets per bucket.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.bpe import cached_bpe
from urlsieve.session import cut_lineage

CAPACITY, END_ID = 2048, 1
BINS = 128
FILLER_SHARE = 16
ROWS_PER_BUCKET = 50_000


# ---------------------------------------------------------------- linear program over patterns

def best_pattern(prices: np.ndarray, bins: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of bin sizes 1..bins with the largest price within ``bins``."""
    value, last = np.zeros(bins + 1), np.zeros(bins + 1, int)
    for c in range(1, bins + 1):
        offers = value[c - 1:: -1] + prices[:c]  # item of size w = 1..c on top of capacity c - w
        w = offers.argmax()
        value[c], last[c] = offers[w], w + 1
    counts, c = np.zeros(bins, int), bins
    while c > 0:
        counts[last[c] - 1] += prices[last[c] - 1] > 0  # an item without a price only fills up
        c -= last[c]
    return float(value[bins]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row exchange; small matrices, and no library threads on the driver."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(work[i:, i]).argmax())
        work[[i, j]] = work[[j, i]]
        work[i] /= work[i, i]
        others = work[:, i].copy()
        others[i] = 0
        work -= np.outer(others, work[i])
    return work[:, n:]


def solve_patterns(demand: Sequence[int], rounds: int = 1500, gap: float = 1e-3) -> list[tuple[float, np.ndarray]]:
    """(uses, pattern) of an optimal basis: least number of sequences that covers the demand per bin.

    Revised simplex with an explicit inverse. It ends when no pattern prices above 1, or when the
    bound that the prices give is within ``gap`` of the present total.
    """
    demand = np.asarray(demand, float)
    bins, rows = len(demand), np.flatnonzero(demand)
    if not len(rows):
        return []
    m = len(rows)
    patterns = []
    for r in rows:  # as many of one size as fit
        p = np.zeros(bins, int)
        p[r] = bins // (r + 1)
        patterns.append(p)
    inverse = np.diag([1 / p[r] for p, r in zip(patterns, rows, strict=True)])
    need = demand[rows]
    use = (inverse * need).sum(axis=1)
    for step in range(rounds):
        if step % 200 == 199:  # rounding errors do not build up
            inverse = inverted(np.array([p[rows] for p in patterns], float).T)
            use = np.maximum((inverse * need).sum(axis=1), 0)
        prices = np.zeros(bins)
        prices[rows] = np.maximum(inverse.sum(axis=0), 0)
        worth, column = best_pattern(prices, bins)
        if worth <= 1 + 1e-9 or use.sum() - (prices[rows] * need).sum() / worth <= gap * use.sum():
            break
        way = (inverse * column[rows]).sum(axis=1)
        ok = way > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, use / np.where(ok, way, 1), np.inf)
        out = int(np.argmin(ratio))
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        shift = ratio[out]
        use = np.maximum(use - shift * way, 0)
        use[out] = shift
        patterns[out] = column
    return [(float(u), p) for u, p in zip(use, patterns, strict=True) if u > 1e-9]


def plan_patterns(demand: Sequence[int]) -> list[tuple[int, np.ndarray]]:
    """(times, pattern): rounded-down patterns, then first-fit decreasing for the rests of rounding.

    Together they hold exactly the demand. The second part has fewer items than bins squared, whatever
    the size of the corpus.
    """
    left = np.asarray(demand, int).copy()
    bins, out = len(left), []
    for use, p in sorted(solve_patterns(demand), key=lambda x: -x[0]):
        fit = min([int(left[b] // p[b]) for b in np.flatnonzero(p)])
        times = min(math.floor(use + 1e-6), fit)
        if times:
            out.append((times, p))
            left -= times * p
    room: list[int] = []
    made: list[np.ndarray] = []
    for b in range(bins - 1, -1, -1):
        for _ in range(int(left[b])):
            fits = [i for i, r in enumerate(room) if r >= b + 1]
            best = min(fits, key=lambda i: room[i]) if fits else None
            if best is None:
                room.append(bins)
                made.append(np.zeros(bins, int))
                best = len(room) - 1
            room[best] -= b + 1
            made[best][b] += 1
    same = Counter(tuple(p) for p in made)
    return out + [(n, np.array(p)) for p, n in sorted(same.items())]


# ---------------------------------------------------------------- distributed numbering

def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, rows: int) -> DataFrame:
    """Add ``out``: the exclusive running sum of ``value`` within ``keys``, along a hashed order.

    Rows are dealt into buckets of about 50,000 by the hash of ``order``; sums per bucket are added up
    over the buckets, so a key with a third of all rows is spread over many tasks.
    """
    n = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    base = df.withColumn("_v", value).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    totals = base.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = base.join(offsets, [*keys, "_b"])
    return joined.withColumn(out, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_b", "_o")


# ---------------------------------------------------------------- the operator

def tokenised(docs: DataFrame, tokenizer: str, pattern: str, key: str, text: str, capacity: int) -> DataFrame:
    """``_key, _n`` (tokens with the end id), ``_crcs`` of the whole sequences, ``_rest`` crc of the
    rest, ``_filler`` and, for fillers, the ids of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(tokenizer, pattern)
        end, whole = END_ID.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            n, crcs, rest, ids = [], [], [], []
            for t, filler in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = bpe.ids(t or "") + end
                cut = len(raw) // whole * whole
                n.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[i: i + whole]) for i in range(0, cut, whole)])
                rest.append(zlib.crc32(raw[cut:]))
                ids.append(raw[cut:] if filler and cut < len(raw) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                 pa.array(rest, pa.int64()), pa.array(ids, pa.binary())],
                ["_key", "_filler", "_n", "_crcs", "_rest", "_ids"])

    slim = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"),
                       (F.pmod(F.xxhash64(F.col(key), F.lit("filler")), F.lit(FILLER_SHARE)) == 0).alias("_filler"))
    return slim.mapInArrow(run, "_key long, _filler boolean, _n long, _crcs array<long>, _rest long, _ids binary")


def pack(
    docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, bins: int = BINS,
) -> DataFrame:
    """Pieces: ``<key>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (long).

    A null or empty text is one document of one token, the end id. Rows that repeat, and rows with a
    null key, are packed once each. An empty table gives no pieces. Sequences hold at most ``capacity``
    tokens; those that are not full and no power of two are to be padded.
    """
    spark = docs.sparkSession
    rows = cut_lineage(tokenised(docs, tokenizer, pattern, key, text, capacity))
    rest = F.col("_n") % capacity
    grain = capacity // bins
    histogram = rows.where(~F.col("_filler") & (rest > 0)).groupBy(
        F.ceil(rest / grain).cast("int").alias("_bin")).agg(F.count("*").alias("n")).collect()  # ``bins`` rows at most
    demand = [0] * bins
    for r in histogram:
        demand[r["_bin"] - 1] = r["n"]
    plan = plan_patterns(demand)
    total = rows.count()
    same = ["_key", "_n", "_rest", "_crcs"]

    # whole sequences, numbered 0, 2, 4, ...; all others get odd numbers
    long_docs = numbered(rows.where(F.col("_n") >= capacity).drop("_ids"), [], same, F.size("_crcs"), "_first", total)
    whole = long_docs.select("_key", "_n", "_first", F.posexplode("_crcs").alias("_i", "ids_crc32")).select(
        "_key", (F.col("_i") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"),
        "ids_crc32", "_n", (2 * (F.col("_first") + F.col("_i"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # rests in patterns: slot numbers per bin follow the patterns
    first_sequence, slots, at, held = 0, [], [0] * bins, []
    for times, p in plan:
        for b in np.flatnonzero(p):
            slots.append((int(b) + 1, at[b], int(p[b]), first_sequence))
            at[b] += times * int(p[b])
        held.append((first_sequence, times))
        first_sequence += times
    ranked = numbered(rows.where(~F.col("_filler") & (rest > 0)).select(*same, F.ceil(rest / grain).cast("int").alias("_bin")),
                      ["_bin"], same, F.lit(1), "_rank", total)
    by_bin: dict[int, list] = {}
    for b, start, per, sequence in slots:
        by_bin.setdefault(b, []).append((start, per, sequence))
    table = spark.createDataFrame(
        [(b, [{"a": x[0], "p": x[1], "q": x[2]} for x in sorted(xs)]) for b, xs in by_bin.items()],
        "_bin int, _slots array<struct<a:long,p:long,q:long>>")  # as many rows as bins, as many slots as patterns
    mine = F.element_at(F.filter("_slots", lambda s: s["a"] <= F.col("_rank")), -1)
    dealt = cut_lineage(ranked.join(F.broadcast(table), "_bin").withColumn("_s", mine).select(
        *same, "_bin", "_rank", (F.col("_s.q") + F.floor((F.col("_rank") - F.col("_s.a")) / F.col("_s.p"))).alias("_q")))
    line = Window.partitionBy("_q").orderBy(F.desc("_bin"), "_rank")
    placed = dealt.withColumn("offset", F.coalesce(
        F.sum(rest).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    patterned = placed.select(
        "_key", (F.col("_n") - rest).alias("start"), rest.alias("length"), F.col("_rest").alias("ids_crc32"), "_n",
        (2 * F.col("_q") + 1).alias("sequence_id"), "offset")

    # gaps and fillers on one line: both are intervals of running totals and meet per block of positions
    gaps = dealt.groupBy("_q").agg((F.lit(capacity) - F.sum(rest)).alias("_gap")).where("_gap > 0 and _gap < " + str(capacity))
    gaps = gaps.where(F.expr(f"bit_count({capacity} - _gap) <> 1"))  # a power of two needs no padding
    gap_line = cut_lineage(numbered(gaps, [], ["_q"], F.col("_gap"), "_a", first_sequence))
    fillers = rows.where(F.col("_filler") & (rest > 0)).select(*same, "_ids", rest.alias("_len"))
    fill_line = cut_lineage(numbered(fillers, [], [*same, "_ids"], F.col("_len"), "_a", total))
    holes = gap_line.agg(F.sum("_gap").alias("s")).first()["s"] or 0
    stream = fill_line.agg(F.sum("_len").alias("s")).first()["s"] or 0
    ends = later_ends(holes, stream, first_sequence, capacity)
    later = fill_line.where(F.col("_a") + F.col("_len") > holes).select(
        "*", F.explode(F.sequence(F.floor(F.greatest(F.col("_a") - holes, F.lit(0)) / capacity),
                                  F.floor((F.col("_a") + F.col("_len") - 1 - holes) / capacity))).alias("_w"))
    tail = F.broadcast(spark.createDataFrame(ends["tail"], "_w long, _x long, _y long, _q long"))
    fresh = later.join(tail, "_w", "left").select(
        *same, "_ids", "_a", "_len",
        F.coalesce("_x", F.lit(holes) + F.col("_w") * capacity).alias("_x"),
        F.coalesce("_y", F.lit(holes) + (F.col("_w") + 1) * capacity).alias("_y"),
        F.coalesce(F.col("_q"), F.lit(first_sequence) + F.col("_w")).alias("_q"), F.lit(0).cast("long").alias("_base"))
    block = 4 * capacity
    spread = lambda df, a, n: df.withColumn("_k", F.explode(F.sequence(
        F.floor(F.col(a) / block), F.floor((F.col(a) + F.col(n) - 1) / block))))
    left = spread(fill_line.where(F.col("_a") < holes), "_a", "_len")
    right = spread(gap_line, "_a", "_gap").select(
        "_k", F.col("_a").alias("_x"), (F.col("_a") + F.col("_gap")).alias("_y"), "_q",
        (F.lit(capacity) - F.col("_gap")).alias("_base"))
    meet = left.join(right, "_k").where(
        (F.greatest("_a", "_x") < F.least(F.col("_a") + F.col("_len"), F.col("_y")))
        & (F.floor(F.greatest("_a", "_x") / block) == F.col("_k")))
    cuts = meet.select(*same, "_ids", "_a", "_len", "_x", "_y", "_q", "_base").unionByName(fresh)
    lo, hi = F.greatest("_a", "_x"), F.least(F.col("_a") + F.col("_len"), F.col("_y"))
    filled = cuts.where(lo < hi).select(
        "_key", (F.col("_n") - F.col("_len") + lo - F.col("_a")).alias("start"), (hi - lo).alias("length"),
        F.crc32(F.substring("_ids", (4 * (lo - F.col("_a")) + 1).cast("int"), (4 * (hi - lo)).cast("int"))).alias("ids_crc32"),
        "_n", (2 * F.col("_q") + 1).alias("sequence_id"), (F.col("_base") + lo - F.col("_x")).alias("offset"))
    return whole.unionByName(patterned).unionByName(filled).select(
        F.col("_key").alias(key), "start", "length", "ids_crc32", F.col("_n").alias("doc_tokens"), "sequence_id", "offset")


def later_ends(holes: int, stream: int, first_sequence: int, capacity: int) -> dict[str, list]:
    """The last, partly filled window of the filler stream, cut into powers of two."""
    over = max(0, stream - holes)
    last, rest = divmod(over, capacity)
    tail, at, q = [], holes + last * capacity, first_sequence + last
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append((last, at, at + (1 << bit), q))
            at, q = at + (1 << bit), q + 1
    return {"tail": tail}
