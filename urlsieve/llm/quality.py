"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (one and two words) are estimated: a target from trusted
documents, and the raw corpus from all documents. A document's score is the mean over its n-grams of
log(target / raw), which is length-normalised by construction; documents below a fixed threshold go.

Everything runs on built-in column functions. Counting explodes n-grams into an aggregate of at most
``cells`` groups, so the shuffle has ``cells`` rows per task whatever the size of the corpus; scoring
happens inside the row. No text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import blank_words, bounded_sample, fence, free_names

WINDOW = 8  # words in a repeated window: fixed by the result contract
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
CELLS = 1 << 15
TARGET_ROWS = 20_000
PRIOR = 20  # pseudo-counts per cell that shrink the target towards the raw corpus
THRESHOLD = -0.1


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``word_hashes``.

    Null and empty texts count as texts without words: all counts are 0. Rows that repeat are counted
    each on their own. Columns of ``docs`` with these names are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_hashes"]
    keep = [c for c in docs.columns if c not in own]
    words, windows, ranked, places, rows = free_names(docs.select(keep), "_words", "_windows", "_ranked", "_places", "_lines")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.select(
        *keep, blank_words(F.col(text)).alias(words),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias(rows),
    )
    out = out.select(
        *keep, "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.size(words) > 0, F.length(F.array_join(words, " ")) - F.size(words) + 1).otherwise(0)
        .cast("long").alias("word_chars"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("word_hashes"),
    )
    hashes = F.col("word_hashes")
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    out = out.withColumn(
        windows,
        F.when(F.size(hashes) > WINDOW,
               F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    # Only documents with a repeated window, which are few, sort their windows.
    repeated = F.size(windows) > F.size(F.array_distinct(windows))
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn(
        ranked,
        F.when(repeated, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop(windows)
    row = F.col(ranked)
    twins = F.filter(row, lambda x, k: F.coalesce(
        ((k > 0) & (F.get(row, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
        | (F.get(row, k + 1)["h"] == x["h"]), F.lit(False)))
    out = out.withColumn(places, F.sort_array(F.transform(twins, lambda x: x["i"]))).drop(ranked)
    spot = F.col(places)
    covered = F.transform(spot, lambda p, k: F.least(F.coalesce(F.get(spot, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")
    return out.withColumn("n_repeat_words", total).drop(places)


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT_PERCENT * F.col(n_words))


def cell_of(hashed: Column, cells: int) -> Column:
    return F.pmod(hashed, F.lit(cells)).cast("int")


def ngram_cells(hashes: Column, cells: int) -> Column:
    """Cells of the one- and two-word n-grams, from an array of word hashes."""
    pairs = F.when(
        F.size(hashes) > 1,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - 2),
                    lambda i: cell_of(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), cells)),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, lambda h: cell_of(h, cells)), pairs)


def cell_counts(docs: DataFrame, trusted: DataFrame, cells: int, key: str, text: str) -> DataFrame:
    """``cell, raw, target``: n-gram occurrences over all documents and over the trusted ones.

    ``trusted`` holds at most a documented number of keys, so it is broadcast.
    """
    marks = trusted.select(F.col(key).alias("_trusted")).distinct()
    words = docs.select(F.col(key).alias("_key"), F.transform(blank_words(F.col(text)), lambda w: F.xxhash64(w)).alias("_w"))
    rows = words.join(F.broadcast(marks), F.col("_key") == F.col("_trusted"), "left").select(
        F.col("_trusted").isNotNull().cast("long").alias("_t"), F.explode(ngram_cells(F.col("_w"), cells)).alias("cell"))
    return rows.groupBy("cell").agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))


def fit_ratio(
    docs: DataFrame, labels: DataFrame, cells: int = CELLS, target_rows: int = TARGET_ROWS,
    key: str = "doc_id", text: str = "text", quality: str = "quality",
) -> list[float]:
    """Log ratio per cell, add-one smoothed, centred so that the trusted text scores 0 on average.

    The target is fitted on at most ``target_rows`` trusted keys (``quality`` = 1), chosen by the hash
    of the key; the raw counts cover every document. ``cells`` numbers reach the driver, a fixed size.
    Without labels or documents every ratio is 0, so only the base rules decide.
    """
    good = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(key).distinct()
    rows = cell_counts(docs, bounded_sample(good, key, target_rows), cells, key, text).collect()
    raw, target = [0] * cells, [0] * cells
    for r in rows:
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * cells
    a, b = sum(raw) + cells, sum(target) + PRIOR * cells
    # pseudo-counts are dealt as the raw corpus, so that cells with few n-grams say little: without them
    # a small corpus would prefer the very documents that the target was fitted on
    ratio = [math.log(((t + PRIOR * cells * (r + 1) / a) / b) / ((r + 1) / a)) for r, t in zip(raw, target, strict=True)]
    centre = sum(t * x for t, x in zip(target, ratio, strict=True)) / sum(target)
    return [round(x - centre, 3) for x in ratio]


def ratio_score(hashes: Column, ratio: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 for a document without words.

    The model travels as one folded literal of fixed size.
    """
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")
    cells = ngram_cells(hashes, len(ratio))
    total = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.get(table, c))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(F.lit(0.0))


def with_quality(
    docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD, text: str = "text",
) -> DataFrame:
    """Add the counts of ``text_stats``, ``base_failed``, ``ratio`` (double) and ``kept``.

    ``kept`` is false when the base rules fail, else whether the score reaches ``threshold``. The same
    document always gets the same verdict under one model. Empty tables give empty tables.
    """
    stats = text_stats(docs, text)
    names = [c for c in stats.columns if c not in ("word_hashes", "base_failed", "ratio", "kept")]
    scored = fence(stats.select(*names, base_failed().alias("base_failed"),
                                ratio_score(F.col("word_hashes"), ratio).alias("ratio")))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
