"""License scans with a positional index of rare words.

A catalogue holds the notices of public licences, each with phrases that it cannot do without. Their
words' inverse document frequencies are counted over the corpus, and each notice is indexed by its
rarest words with their positions. A file's licence words are looked up, rarest first; every posting
votes for the place where the notice would start (place in the file minus place in the notice), so
postings of one notice are intersected by relative position. Starts with enough votes are verified word
by word, and by each mandatory phrase at its place. Where the texts of two licences overlap (BSD with
three clauses holds the one with two), the more special one stands.

The index is small, so files are scanned where they lie, in Arrow batches. Only counts of catalogue
words are shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import free_names

# Fixed by the result contract: base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GNU = "is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met")
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"

# Wording of public licence notices, as (label, notice, mandatory phrases).
CATALOGUE = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software", ("hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                   "license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", _GNU.format("gnu general public license") + " either version 3 of the license",
     ("gnu general public license", "either version 3")),
    ("gpl-2.0", _GNU.format("gnu general public license") + " either version 2 of the license",
     ("gnu general public license", "either version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("lesser general public license version 2 1",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("lgpl-2.1", _GNU.format("gnu lesser general public license") + " either version 2 1 of the license",
     ("lesser general public license", "either version 2 1")),
    ("lgpl-3.0", _GNU.format("gnu lesser general public license") + " either version 3 of the license",
     ("lesser general public license", "either version 3")),
    ("agpl", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("agpl-3.0", _GNU.format("gnu affero general public license") + " either version 3 of the license",
     ("affero general public license", "either version 3")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
                "distributed with this file you can obtain one at", ("mozilla public license",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
     ("eclipse public license 2 0",)),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
     ("eclipse public license v1 0",)),
    ("bsd-2-clause", _BSD + " redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer", ("redistribution and use in source and binary forms",)),
    ("bsd-2-clause", _BSD, ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", _ISC + " provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "all copies")),
    ("isc", _ISC, ("with or without fee",)),
    ("0bsd", _ISC + " the software is provided as is", ("with or without fee is hereby granted the software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
             "damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
     ("must not be misrepresented",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("cc0-1.0", "licensed under cc0 1 0", ("cc0 1 0",)),
    ("cc0-1.0", "the creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by", "licensed under the creative commons attribution license", ("creative commons attribution license",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
     ("attribution noncommercial sharealike",)),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
     ("attribution noncommercial noderivatives",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
# A licence whose notice holds, or looks like, that of others: within one place only the first stands.
SPECIAL = {
    "bsd-3-clause": ("bsd-2-clause",), "0bsd": ("isc",), "gpl-2.0": ("gpl-3.0",), "lgpl-2.1": ("lgpl-3.0",),
    "cc-by-sa": ("cc-by",), "cc-by-nc": ("cc-by",), "cc-by-nd": ("cc-by",),
    "cc-by-nc-sa": ("cc-by", "cc-by-nc", "cc-by-sa"), "cc-by-nc-nd": ("cc-by", "cc-by-nc", "cc-by-nd"),
}
REACH = 400  # words between the parts of one licence text
COMMON = frozenset("a and any are as at be by for in is it of or that the this to use with without version under you your not".split())
ANCHORS = 4  # rarest distinct words of a notice by which it is found
SHARE = 0.6  # of a notice's weight that must match at one start
SLACK = 3  # words by which a mandatory phrase may be off its place
TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters of a whole text."""
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


@dataclass
class LicenseIndex:
    """Postings (word -> notice, place) of the notices' rarest words, and of the base phrases.

    ``idf`` are inverse document frequencies over a corpus (see :func:`corpus_idf`); words it lacks count as
    the rarest ones.
    """

    idf: Mapping[bytes, float] = field(default_factory=dict)
    catalogue: tuple = CATALOGUE
    share: float = SHARE
    notices: list[tuple[str, list[bytes], list[tuple[int, list[bytes]]]]] = field(default_factory=list)
    weight: dict[bytes, float] = field(default_factory=dict)
    anchors: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    needed: list[int] = field(default_factory=list)
    base: dict[bytes, list[tuple[list[bytes], str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for label, text, keys in self.catalogue:
            ws = words_of(text)
            placed = []
            for key in map(words_of, keys):
                placed.append((next(i for i in range(len(ws)) if ws[i: i + len(key)] == key), key))
            self.notices.append((label, ws, placed))
        rarest = max(self.idf.values(), default=1.0)
        spread = Counter(w for _, ws, _ in self.notices for w in set(ws))
        common = {w.encode() for w in COMMON}
        # a word of few notices tells more than one of many, wherever the corpus has it
        self.weight = {w: (0.1 if w in common else 1.0) * max(self.idf.get(w, rarest), 0.1) * math.log(1 + len(self.notices) / c)
                       for w, c in spread.items()}
        postings = defaultdict(list)
        for i, (_, ws, _) in enumerate(self.notices):
            rare = sorted(set(ws) - common, key=lambda w: (-self.weight[w], w))[:ANCHORS]
            self.needed.append(min(2, len(rare)))
            for at, w in enumerate(ws):
                if w in rare:
                    postings[w].append((i, at))
        self.anchors = dict(postings)
        phrases = defaultdict(list)
        for phrase, label in BASE:
            ws = words_of(phrase)
            phrases[ws[0]].append((ws, label))
        self.base = dict(phrases)

    def found(self, words: list[bytes], at_of: dict[bytes, list[int]]) -> list[tuple[str, int, int, float]]:
        """Verified notices as (label, first word, end, share of the weight that matches)."""
        votes = defaultdict(set)
        for w in sorted(at_of, key=lambda w: (-self.weight.get(w, 0.0), w)):
            for i, inside in self.anchors.get(w, ()):
                for at in at_of[w]:
                    votes[i, at - inside].add(w)
        out = []
        for (i, start), some in votes.items():
            label, notice, keys = self.notices[i]
            if len(some) < self.needed[i]:
                continue
            total = sum(self.weight[w] for w in notice)
            got = sum(self.weight[w] for k, w in enumerate(notice) if 0 <= start + k < len(words) and words[start + k] == w)
            if got >= self.share * total and all(self._stands(words, start + at, key) for at, key in keys):
                out.append((label, start, start + len(notice), got / total))
        return out

    @staticmethod
    def _stands(words: list[bytes], at: int, phrase: list[bytes]) -> bool:
        return any(words[i: i + len(phrase)] == phrase for i in range(max(0, at - SLACK), at + SLACK + 1))

    @staticmethod
    def told_apart(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Without those that a more special licence near them explains, or a better match of its kin at the same words."""
        found = sorted(found, key=lambda x: x[1])
        starts, widest = [x[1] for x in found], max((e - s for _, s, e, _ in found), default=0)
        out = []
        for label, start, end, share in found:
            near = found[bisect_left(starts, start - widest - REACH): bisect_left(starts, end + REACH)]
            hidden = any(
                (label in SPECIAL.get(other, ()) and s < end + REACH and start < e + REACH and not (other in ("gpl-2.0", "lgpl-2.1") and p < share))
                or (other in SPECIAL.get(label, ()) and s < end and start < e and p > share)
                for other, s, e, p in near)
            if not hidden:
                out.append((label, start, end, share))
        return out

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        wanted = {w for w in set(words) if w in self.anchors or w in self.base}
        if not wanted:
            return len(words), 0, None, None, "", "", 0.0
        at_of, places, base = defaultdict(list), [], set()
        for at, w in enumerate(words):
            if w not in wanted:
                continue
            at_of[w].append(at)
            for phrase, label in self.base.get(w, ()):
                if words[at: at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
        own = self.told_apart(self.found(words, at_of))
        labels, score = base | {x[0] for x in own}, max((x[3] for x in own), default=0.0)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6)


def corpus_idf(docs: DataFrame, text: str = "text", catalogue: tuple = CATALOGUE) -> dict[bytes, float]:
    """Inverse document frequency of every catalogue word over all rows; at most as many as the catalogue has words."""
    known = frozenset(w for _, t, _ in catalogue for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            for t in b.column(0).to_pylist():
                seen.update(known.intersection(words_of(t)))
        words = [*seen, b""]  # the empty word stands for the rows themselves
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*seen.values(), rows], pa.int64())], ["word", "n"])

    sums = {bytes(r["word"]): r["n"] for r in docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = sums.pop(b"", 0)
    return {w: math.log((1 + rows) / (1 + sums.get(w, 0))) + 0.1 for w in known}


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def with_licenses(docs: DataFrame, index: LicenseIndex | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus the scan's columns; without an index, frequencies are those of ``docs``.

    ``score`` is the best share of a verified notice's weight; base phrases alone give labels, and no score. Null and empty texts have no words, no places, empty label lists and score 0. Every row, copies and
    rows without a key included, is scanned on its own. Columns of the result's names are replaced.
    """
    index = index or LicenseIndex(corpus_idf(docs, text))
    keep = [c for c in docs.columns if c not in RESULT]
    (found,) = free_names(docs, "_found")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    shape = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"

    @F.arrow_udf(shape)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [index.scan(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(RESULT))

    return docs.select(*keep, scan(F.col(text)).alias(found)).select(*keep, f"{found}.*")
