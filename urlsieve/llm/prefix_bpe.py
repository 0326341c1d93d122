"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a byte string has one BPE encoding, and the last token of that encoding is unique. So an
encoding needs no merge queue: for each prefix, of the tokens that end there, the last token is the one
that may follow the last token of the shorter prefix it leaves. Token ``b`` may follow ``a`` when merging
the joined bytes of both gives back ``a, b``. Walking back over the stored tokens gives the ids.

The stored tokens depend on earlier bytes only. Appending bytes adds entries and changes none; after a
change in the middle, entries before it stay, and those behind it are the old ones again as soon as as
many of them agree in a row as the longest token has bytes.

Texts fall into matches of a split pattern, each a byte string of its own. Short matches are kept in a
bounded dictionary per worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_CHARS, CACHED, CACHED_PAIRS = 40, 300_000, 500_000
SLICE = 512  # rows a worker encodes at a time: ids take more room than text
#: A match of the public split pattern is settled by the characters up to two behind its end, and by three from its start.
LOOK_BEHIND_START, LOOK_BEHIND_END = 3, 2


class PrefixBpe:
    """A rank table with the pair test and the prefix recurrence."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.bytes_of = [b""] * (1 + max(self.ranks.values()))
        for piece, i in self.ranks.items():
            self.bytes_of[i] = piece
        self.longest = max(map(len, self.ranks))
        #: token of every token's ends, -1 for ends that are no tokens
        self.tails = {t[i:]: -1 for t in self.ranks for i in range(len(t))} | self.ranks
        self.split = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        #: matches met lately and before; the older half goes when the newer one is full
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Merging by definition, by ranks under ``below``: least rank first, leftmost on ties."""
        parts = [data[i: i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            i = ranks.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``."""
        got = self.halves.get(token)
        if got is None:
            left, right = self.merged(self.bytes_of[token], token)
            got = self.halves[token] = self.ranks[left], self.ranks[right]
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of both tokens gives back both.

        Seen backwards in time, the parts that touch at the border are those of the two tokens, then of the
        parts they were merged from, the later merge undone first. The pair is torn apart if at some time
        the touching parts would have merged before either was used up on its own side. Of equal ranks the
        left one merges first.
        """
        of, ranks = self.bytes_of, self.ranks
        a_used = b_used = len(ranks)
        while True:
            joint = ranks.get(of[a] + of[b])
            if joint is not None and joint < a_used and joint <= b_used:
                return False
            a_whole, b_whole = len(of[a]) > 1, len(of[b]) > 1
            if a_whole and (a > b or not b_whole):
                a_used, a = a, self.parts(a)[1]
            elif b_whole:
                b_used, b = b, self.parts(b)[0]
            else:
                return True

    def table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes; ``last`` may give those of the first ones."""
        last = list(last or ())
        self.grow(data, last, len(data))
        return last

    def grow(self, data: bytes, last: list[int], upto: int) -> None:
        """Append the last tokens of longer prefixes, to that of ``upto`` bytes.

        Of the tokens that end where a prefix ends, its last one is the one that fits the prefix before it.
        """
        tails, pairs = self.tails.get, self.pairs
        for end in range(len(last) + 1, upto + 1):
            start = end - 1
            while True:
                token = tails(data[start:end])
                if token is None:
                    raise ValueError("the rank table lacks a byte")
                if token >= 0:
                    if not start:
                        break
                    pair = last[start - 1] << 32 | token
                    fit = pairs.get(pair)
                    if fit is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        fit = pairs[pair] = self.fits(last[start - 1], token)
                    if fit:
                        break
                start -= 1
            last.append(token)

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of a match. A match that is a token stands for itself, as the library has it."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, add = self.known, out.extend
        for piece in self.split.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    data = piece.encode("utf-8", "replace")
                    ids = tuple(self.ids(data, [] if data in self.ranks else self.table(data)))
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHED:
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = ids
            add(ids)
        return out

    def decode(self, ids: list[int] | None) -> bytes:
        """Bytes of the ids. Ids beyond the table are an error, nulls and empty lists give no bytes."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids or ()])


class PrefixTable:
    """The stored last tokens of one byte string, which can be appended to and edited."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b"", last: list[int] | None = None):
        self.bpe, self.data = bpe, data
        self.last = bpe.table(data, last)
        self.work = len(data) - len(last or ())  #: prefixes evaluated so far

    def append(self, more: bytes) -> None:
        self.data += more
        self.work += len(more)
        self.last = self.bpe.table(self.data, self.last)

    def replace(self, at: int, gone: int, new: bytes) -> None:
        """Put ``new`` in the place of ``gone`` bytes at ``at``; stops where old entries hold again."""
        old, shift = self.last, len(new) - gone
        self.data = self.data[:at] + new + self.data[at + gone:]
        last, same = old[:at], 0
        for end in range(at + 1, len(self.data) + 1):
            self.bpe.grow(self.data, last, end)
            self.work += 1
            was = end - shift  # the old prefix that ended at the same byte
            same = same + 1 if end > at + len(new) and was >= 1 and old[was - 1] == last[-1] else 0
            if same >= self.bpe.longest:
                last += old[was:]
                break
        self.last = last

    def ids(self) -> list[int]:
        return self.bpe.ids(self.data, self.last)


class TextTable:
    """The stored tables of a whole text, match by match; edits re-encode only what they reach.

    Exact for the public split pattern, whose matches are settled by the few characters named above.
    """

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text, self.work = bpe, "", 0
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), 0, more)

    def replace(self, at: int, gone: int, new: str) -> None:
        """Put ``new`` in the place of ``gone`` characters at ``at``."""
        ends = [*self.starts[1:], len(self.text)]
        shift, behind = len(new) - gone, at + len(new)
        self.text = self.text[:at] + new + self.text[at + gone:]
        stay = len(self.starts)
        while stay and (ends[stay - 1] + LOOK_BEHIND_END > at or self.starts[stay - 1] + LOOK_BEHIND_START > at):
            stay -= 1
        begin = self.starts[stay] if stay < len(self.starts) else (ends[-1] if self.starts else 0)
        place = {s + shift: i for i, s in enumerate(self.starts) if i >= stay}
        starts, pieces, rest = [], [], len(self.starts)
        for m in self.bpe.split.finditer(self.text, begin):
            if m.start() >= behind and m.start() in place:
                rest = place[m.start()]
                break
            starts.append(m.start())
            pieces.append(m.group().encode("utf-8", "replace"))
        tables = []
        for i, data in enumerate(pieces):
            if i == 0 and stay < rest:  # the first changed match keeps the entries of the bytes it has in common
                old = self.tables[stay]
                common = next((j for j, (a, b) in enumerate(zip(old.data, data)) if a != b), min(len(old.data), len(data)))
                tail = 0
                if len(pieces) == 1 and rest == stay + 1:  # and, if it is the only one, may find back to the old ones
                    room = min(len(old.data), len(data)) - common
                    tail = next((j for j in range(room) if old.data[-1 - j] != data[-1 - j]), room)
                table = PrefixTable(self.bpe, old.data, old.last)
                table.replace(common, len(old.data) - common - tail, data[common: len(data) - tail])
            else:
                table = PrefixTable(self.bpe, data)
            self.work += table.work
            tables.append(table)
        self.starts[stay:] = starts + [s + shift for s in self.starts[rest:]]
        self.tables[stay:] = tables + self.tables[rest:]

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in t.ids()]


@lru_cache(maxsize=2)
def prefix_bpe(path: str, pattern: str) -> PrefixBpe:
    """One rank table per worker process."""
    return PrefixBpe(path, pattern)


def lists(rows: list[list[int]]) -> pa.Array:
    """Rows of ids as an Arrow list array."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    flat = np.fromiter((i for r in rows for i in r), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encoded(text: Column, ranks: str, pattern: str) -> Column:
    """Ids (array<int>) of whole texts; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        bpe = prefix_bpe(ranks, pattern)
        return lists([bpe.encode(t) for t in texts.to_pylist()])

    return run(text)


def decoded(ids: Column, ranks: str, pattern: str) -> Column:
    """Bytes of ids; null and empty arrays give no bytes. Not cast to text: ids may end inside a character."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        bpe = prefix_bpe(ranks, pattern)
        return pa.array([bpe.decode(r) for r in rows.to_pylist()], pa.binary())

    return run(ids)


def round_trips(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, ids (array<int>), decoded (binary)`` of every row, in one pass and without a shuffle.

    Null texts count as empty and have no ids; keys of any type, null and repeated ones included, stay as
    they are; other columns are left out. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                rows = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists(rows), pa.array(map(bpe.decode, rows), pa.binary())], ["k", "ids", "decoded"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([
        T.StructField("k", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType())])
    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)


def with_edits(
    edits: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", at: str = "at", gone: str = "gone", new: str = "new",
) -> DataFrame:
    """``<key>, ids, n_prefixes`` per row: the ids of ``text`` after ``gone`` characters at ``at`` gave way to ``new``.

    The text's tables are built once and edited; ``n_prefixes`` counts the byte prefixes the edit evaluated.
    An append is an edit at the end: ``at`` null or beyond it. Null texts count as empty, null ``gone`` as 0,
    null ``new`` as empty, a negative ``at`` or ``gone`` as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(ranks, pattern)
        for b in batches:
            rows, work = [], []
            for t, a, g, n in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                table = TextTable(bpe, t or "")
                before, size = table.work, len(t or "")
                a = size if a is None else min(max(a, 0), size)
                table.replace(a, min(max(g or 0, 0), size - a), n or "")
                rows.append(table.ids())
                work.append(table.work - before)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(rows), pa.array(work, pa.int64())], ["k", "ids", "n_prefixes"])

    slim = edits.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(at).cast("int"), F.col(gone).cast("int"), F.col(new).cast("string"))
    schema = T.StructType([
        T.StructField("k", edits.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_prefixes", T.LongType())])
    return slim.mapInArrow(run, schema).withColumnRenamed("k", key)
