"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, 0x20 and 0x09-0x0D: fixed by the result contracts.
BLANK = " \t\n\x0b\x0c\r"
BLANKS = "[\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from its folder, whatever folder the driver started in."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fence(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Project, and keep later filters from being pushed back into the projected expressions.

    A filter that moves below a projection computes its expressions a second time; it cannot move
    below a generator.
    """
    names = columns or tuple(df.columns)
    return df.select(F.inline(F.array(F.struct(*names))))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Helper column names that do not clash with those of ``df``, whatever it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blank_words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space. Null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at every run: those whose key has the smallest hashes."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)
