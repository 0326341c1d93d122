"""Alignment of two tokenizers' tokens over the same bytes, as Arrow kernels in Spark tasks.

Both encodings of a text are lists of ids. A batch is flattened (values and parent indices), token byte
lengths are summed up and cut back at each text's start, which gives every token the byte at which it
ends. A full outer hash join of both sides on (text, end) lays both token sequences on one line of cuts:
where a side has no token that ends at a cut, the next one that ends is the one that covers it. So every
cut is one link (a pair of token occurrences whose byte ranges overlap), and a cut where both end closes
a group. Pair counts are grouped per batch by the same kernels; Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.llm.bpe import ExactBpe
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import run_dir

CHARS = 2_000_000  # of text that one round of kernels takes; a longer text is a round of its own
DOC_BITS = 32
DOC = 1 << DOC_BITS
PAIR = 1 << 32  # a pair of ids is one number: A's id times this, plus B's


class PlainBpe(ExactBpe):
    """Tokenizer A: strings of special tokens inside texts are plain text."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        self.library.encode_special_tokens = True
        self.added = []
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # printable spelling of bytes
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        known = self.library.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (1 + max(known.values()))
        for piece, i in known.items():
            if all(c in byte for c in piece):
                self.bytes[i] = bytes(byte[c] for c in piece)
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)


class Pieces:
    """Tokenizer B: a leading space is its own; byte pieces stand for their byte, U+2581 for a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = [
            bytes((int(model.id_to_piece(i)[3:5], 16),)) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(size)]
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)


@lru_cache(maxsize=2)
def both(bpe: str, pattern: str, pieces: str) -> tuple[PlainBpe, Pieces]:
    """Both tokenizers, once per worker process."""
    return PlainBpe(bpe, pattern), Pieces(pieces)


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def joined_bytes(ids: pa.ListArray, spelled: list[bytes]) -> pa.Array:
    tokens = pc.take(pa.array(spelled, pa.binary()), pc.list_flatten(ids))
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), b"")


def ids_of(a: PlainBpe, b: Pieces, texts: list[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of both sides; none for null and empty texts, and where the joined bytes differ from space+text."""
    none = np.empty(0, np.int32)
    left = [np.frombuffer(a.ids(" " + t), "<u4").astype(np.int32) if t else none for t in texts]
    right = [np.asarray(y, np.int32) for y in b.library.encode([t or "" for t in texts], num_threads=1)]
    x, y = list_array(left), list_array(right)
    want = pa.array([b" " + t.encode("utf-8", "replace") if t else b"" for t in texts], pa.binary())
    same = pc.and_(pc.equal(joined_bytes(x, a.bytes), want), pc.equal(joined_bytes(y, b.bytes), want)).to_pylist()
    if all(same):
        return x, y
    return tuple(list_array([v if ok else none for v, ok in zip(side, same, strict=True)]) for side in (left, right))


def token_ends(ids: pa.ListArray, lengths: np.ndarray) -> pa.Array:
    """Per token one number, growing along the batch: its text times 2^32, plus the byte of the text where it ends."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(pa.array(lengths), flat))
    # segmented: less the running sum at the last token of all earlier texts
    upto = pa.array(np.concatenate([[0], total.to_numpy(zero_copy_only=False)]).astype(np.int64))
    base = pc.take(pc.take(upto, ids.offsets), parent)
    return pc.add(pc.multiply(parent, DOC), pc.subtract(total, base))


def links(a_ids: pa.ListArray, b_ids: pa.ListArray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> pa.Table:
    """``doc, a, b, a_at, b_at`` of every link, in order: ids, and the tokens' places in the batch.

    ``a_at`` is null where A's token goes on behind the link, likewise ``b_at``; where neither is, a group closes.
    """
    sides = [
        pa.table({"end": token_ends(ids, lengths), n: pc.list_flatten(ids), f"{n}_at": pa.array(np.arange(len(ids.values)), pa.int32())})
        for n, ids, lengths in (("a", a_ids, a_lengths), ("b", b_ids, b_lengths))]
    met = sides[0].join(sides[1], "end", join_type="full outer", use_threads=False)
    met = met.take(pc.sort_indices(met["end"])).combine_chunks()
    # the next token that ends is the one that covers the cut; both end with the text, so none crosses it
    filled = {n: pc.fill_null_backward(met[n]) for n in ("a", "b")}
    return pa.table({"doc": pc.cast(pc.shift_right(met["end"], DOC_BITS), pa.int32()), **filled, "a_at": met["a_at"], "b_at": met["b_at"]})


def group_texts(ids: pa.ListArray, closers: pa.ChunkedArray) -> pa.Array:
    """Per group the decimal ids of one side, comma-joined; ``closers`` are the side's tokens that close groups."""
    offsets = np.concatenate([[0], closers.to_numpy().astype(np.int64) + 1]).astype(np.int32)
    words = pc.cast(pc.list_flatten(ids), pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), ",")


def rendered(line: pa.Table, a_ids: pa.ListArray, b_ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Groups of every text as ``a1,a2|b1;a3|b2,b3``, and their number."""
    cuts = line.filter(pc.and_(pc.is_valid(line["a_at"]), pc.is_valid(line["b_at"])))
    groups = pc.binary_join_element_wise(group_texts(a_ids, cuts["a_at"]), group_texts(b_ids, cuts["b_at"]), "|")
    n = np.bincount(cuts["doc"].to_numpy(), minlength=len(a_ids)).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";"), pa.array(n)


def rounds(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of characters (of column ``at``); a longer row is a slice of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        start, room = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and room + size > CHARS:
                yield b.slice(start, i - start)
                start, room = i, 0
            room += size
        yield b.slice(start)


def align(docs: DataFrame, bpe: str, pattern: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, n_a, n_b, n_groups, n_links`` (long), ``groups`` (string), ``pairs`` (array<long>), ``pair_links`` (array<int>) per row.

    ``pairs`` are the distinct id pairs of the text's links (A's id times 2^32 plus B's) and ``pair_links``
    how many links hold each. Texts that are null or empty, or that a tokenizer does not give back byte by
    byte, have no tokens: zeros, an empty string, empty arrays. Rows that repeat and null keys stay; other
    columns are left out; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = both(bpe, pattern, pieces)
        for part in rounds(batches, 1):
            left, right = ids_of(a, b, part.column(1).to_pylist())
            line = links(left, right, a.lengths, b.lengths)
            groups, n_groups = rendered(line, left, right)
            pair = pc.add(pc.multiply(pc.cast(line["a"], pa.int64()), PAIR), pc.cast(line["b"], pa.int64()))
            counts = pa.table({"doc": line["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
            counts = counts.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
            rows = np.arange(part.num_rows + 1)
            of = lambda t: pa.array(np.searchsorted(t["doc"].to_numpy(), rows).astype(np.int32))
            n_links = np.diff(of(line).to_numpy()).astype(np.int64)
            flat = lambda n, kind: pc.cast(counts[n], kind).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.cast(pc.list_value_length(left), pa.int64()), pc.cast(pc.list_value_length(right), pa.int64()),
                 n_groups, pa.array(n_links), groups,
                 pa.ListArray.from_arrays(of(counts), flat("pair", pa.int64())),
                 pa.ListArray.from_arrays(of(counts), flat("count_all", pa.int32()))],
                ["k", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([
        T.StructField("k", docs.schema[key].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("pair_links", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: links that hold an id pair anywhere, and whether no pair with its B id has more.

    Batches send one row per pair they hold; the merge is a sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = pa.table({"pair": pc.list_flatten(b.column(0)), "n": pc.cast(pc.list_flatten(b.column(1)), pa.int64())})
            got = flat.group_by("pair", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            yield from got.select(["pair", "n_sum"]).rename_columns(["pair", "n"]).to_batches()

    part = aligned.select("pairs", "pair_links").mapInArrow(run, "pair long, n long")
    counts = part.groupBy("pair").agg(F.sum("n").alias("n"))
    most = counts.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair") % PAIR == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def stored(df: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    home = run_dir(spark, purpose)
    df.write.parquet(home)
    return spark.read.parquet(home)


def with_corpus_counts(aligned: DataFrame, row: str) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` (long) to a stored result of :func:`align`, and drops its arrays.

    ``row`` numbers the rows (keys may repeat). Pairs meet their counts in a join that broadcasts the
    counts only if they are measured to be small, and splits pairs that hold many rows otherwise.
    """
    pairs = aligned.select(row, F.explode(F.arrays_zip("pairs", "pair_links")).alias("_p")).select(
        row, F.col("_p.pairs").alias("pair"), F.col("_p.pair_links").alias("_links"))
    met = lookup_join(pairs, pair_counts(aligned), "pair")
    sums = met.groupBy(F.col(row).alias("_row")).agg(
        F.sum(F.when(F.col("best"), F.col("_links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("_links")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rest = [c for c in aligned.columns if c not in ("pairs", "pair_links", row)]
    return aligned.select(row, *rest).join(sums, F.col(row) == F.col("_row"), "left").select(*rest, zero("n_best"), zero("count_sum"))
