"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (by the model's own rules: a leading mark,
blanks to marks, runs of blanks to one), the pieces (a prefix automaton, whose final states emit a piece)
and byte fallback (a character outside the vocabulary becomes the arcs of its UTF-8 bytes). Composed with
an input they give a lattice over its characters; only arcs that the automaton still follows exist.

The model is of the merging kind: its encoding is not the path with the best sum of piece scores. It is
the one path on which every two neighbouring pieces are what merging makes of their joined text. So the
composition has a last acceptor over pairs of pieces, with weight 0 for such pairs and 1 for all others,
and the encoding is the tropical shortest path (least number of bad pairs, which is 0).

No piece has a mark after another character, so the lattice falls apart at marks: stretches between
marks are encoded on their own, and short ones are kept in a bounded dictionary per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_CHARS, CACHED, CACHED_PAIRS = 40, 300_000, 500_000
OTHER = 1 << 21  # number of the fallback arc of a character: this plus its code point; other arcs have their piece's id
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
FINAL = ""  # key of an automaton state under which the id of its piece stands; no character is empty


def message(data: bytes) -> dict[int, list]:
    """Fields of a serialised protocol-buffer message: numbers, or bytes of nested messages and strings."""
    fields: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = number() if size is None else size
            value = data[at: at + size]
            at += size
        fields.setdefault(tag >> 3, []).append(value)
    return fields


class Normaliser:
    """The model's normalisation; a model with a character map of its own is refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rules = message(message(f.read()).get(3, [b""])[-1])
        if rules.get(2, [b""])[-1]:
            raise ValueError("models with a character map are not supported")
        self.lead, self.squeeze, self.escape = (bool(rules.get(i, [1])[-1]) for i in (3, 4, 5))

    def __call__(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " * self.lead + text).replace(" ", MARK if self.escape else " ")


class PieceTransducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = Normaliser(path)
        self.spelled: list[bytes] = []  # what an id decodes to, marks as blanks
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.root: dict = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            self.spelled.append(piece.replace(MARK, " ").encode() if plain else b"")
            if plain:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                state = self.root
                for c in piece:
                    state = state.setdefault(c, {})
                state[FINAL] = i
            elif model.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes[byte], self.byte_of[i], self.spelled[i] = i, byte, bytes((byte,))
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[int, bool] = {}
        #: stretches met lately and before; the older half goes when the newer one is full
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.texts = {i: p for p, i in self.ids.items()}

    def merged(self, text: str, above: float = -np.inf) -> list[str]:
        """Merging by definition, by scores over ``above``: the best-scored neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, above) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best <= above:
                break
            i = scores.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece; None where merging does not make it."""
        if piece not in self.halves:
            made = self.merged(piece, self.score[piece])
            self.halves[piece] = tuple(made) if len(made) == 2 else None
        return self.halves[piece]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the joined text gives both pieces back.

        Undone from its end, merging shows at the border ever smaller parts of both; the pair is torn apart
        where two touching parts have a merge that comes before those that used them up. Leftmost on ties.
        """
        score, a_used, b_used = self.score, -np.inf, -np.inf
        first = (a, b)
        while True:
            joint = score.get(a + b)
            if joint is not None and joint > a_used and joint >= b_used:
                return False
            x, y = (score[p] if len(p) > 1 else None for p in (a, b))
            if x is None and y is None:
                return True
            left = y is None or (x is not None and x < y)  # the later merge is undone first
            made = self.parts(a if left else b)
            if made is None:
                return self.merged("".join(first)) == list(first)
            if left:
                a_used, a = x, made[1]
            else:
                b_used, b = y, made[0]

    def arc(self, number: int) -> str:
        return self.texts[number] if number < OTHER else chr(number - OTHER)

    def shortest(self, text: str) -> list[int]:
        """Tropical shortest path through the lattice of a stretch, as arcs."""
        n, root, pairs = len(text), self.root, self.pairs
        cost: list[int | None] = [None] * (n + 1)
        last = [0] * (n + 1)
        cost[0] = 0
        for start in range(n):
            before, here = last[start], cost[start]
            state, end, c = root, start, text[start]
            while True:
                state = state.get(c)
                end += 1
                piece = state.get(FINAL) if state is not None else None
                if piece is None and end == start + 1:
                    piece = OTHER + ord(c)  # byte fallback
                if piece is not None and cost[end] != 0:
                    if start:
                        pair = before << 32 | piece
                        fit = pairs.get(pair)
                        if fit is None:
                            if len(pairs) >= CACHED_PAIRS:
                                pairs.clear()
                            fit = pairs[pair] = self.fits(self.arc(before), self.arc(piece))
                        weight = here if fit else here + 1
                    else:
                        weight = here
                    if cost[end] is None or weight < cost[end]:
                        cost[end], last[end] = weight, piece
                if state is None or end == n:
                    break
                c = text[end]
        out, end = [], n
        while end:
            out.append(last[end])
            end -= 1 if last[end] >= OTHER else len(self.texts[last[end]])
        return out[::-1]

    def emit(self, arcs: list[int]) -> tuple[int, ...]:
        """Ids of a path: a piece's own, or those of a character's bytes."""
        if max(arcs) < OTHER:
            return tuple(arcs)
        return tuple(i for a in arcs for i in ((a,) if a < OTHER else (self.bytes[b] for b in chr(a - OTHER).encode("utf-8", "replace"))))

    def encode(self, text: str | None) -> list[int]:
        body = self.normalise(text or "")
        out: list[int] = []
        known, add = self.known, out.extend
        for stretch in STRETCH.findall(body) if self.splits else [body] * bool(body):
            ids = known.get(stretch)
            if ids is None:
                ids = self.older.get(stretch) or self.emit(self.shortest(stretch))
                if len(stretch) <= CACHED_CHARS:
                    if len(known) >= CACHED:
                        self.older, self.known = known, {}
                        known = self.known
                    known[stretch] = ids
            add(ids)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The inverse: pieces and bytes joined, marks to blanks, the leading blank dropped."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids or ()]).decode("utf-8", "replace")
        return text[1:] if self.normalise.lead and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One transducer per worker process."""
    return PieceTransducer(path)


def encoded(text: Column, model: str) -> Column:
    """Ids (array<int>) of whole texts; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        machine = transducer(model)
        rows = [np.asarray(machine.encode(t), np.int32) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    return run(text)


def decoded(ids: Column, model: str) -> Column:
    """Texts from ids; null and empty arrays give the empty text."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        machine = transducer(model)
        return pa.array([machine.decode(r) for r in rows.to_pylist()], pa.string())

    return run(ids)


def round_trips(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, ids, n_ids, n_fallback, round_trip`` of every row: encoding, and whether decoding gives
    the text back (a null counts as the empty text). Rows that repeat stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        fallback = np.zeros(len(machine.spelled), bool)
        fallback[list(machine.byte_of)] = True
        for b in batches:
            for at in range(0, max(1, b.num_rows), 512):  # small batches: ids take more room than text
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [machine.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
                upto = np.concatenate([[0], np.cumsum(fallback[flat])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(np.diff(ends)),
                     pa.array(np.diff(upto[ends]).astype(np.int64)),
                     pa.array([machine.decode(x) == t for x, t in zip(ids, texts, strict=True)])],
                    ["k", "ids", "n_ids", "n_fallback", "round_trip"])

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, "k long, ids array<int>, n_ids long, n_fallback long, round_trip boolean").withColumnRenamed("k", key)
