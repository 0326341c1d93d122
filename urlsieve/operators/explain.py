"""Per-row explanations: which features or which parts of a URL moved a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.text import strip
from urlsieve.operators import features as FE, pages as P
from urlsieve.operators.lookups import lookup_join
from urlsieve.operators.models import URL_NGRAMS
from urlsieve.session import cut_lineage, spread_by

BLOCK = 4


def _ranked(values: Mapping[str, Column], extra: Mapping[str, Mapping[str, Column]], k: int) -> Column:
    """Top k named values of a row by size, as an array of structs; ties keep feature order."""
    items = [
        F.struct(
            (-F.abs(value)).alias("key"), F.lit(i).alias("position"), F.lit(name).alias("name"),
            value.alias("value"), *(cols[name].alias(c) for c, cols in extra.items()),
        )
        for i, (name, value) in enumerate(values.items())
    ]
    return F.slice(F.sort_array(F.array(*items)), 1, k)


def top_zscores(
    normalized: DataFrame, keep: Sequence[str], k: int = 5, names: Sequence[str] = K.LEXICAL_FEATURES
) -> DataFrame:
    """The k lexical features furthest from the training mean, per row."""
    top = _ranked({n: F.col(n) for n in names}, {}, k)
    rows = normalized.select(*keep, F.posexplode(top).alias("rank", "t"))
    return rows.select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("t.name").alias("feature"),
        F.col("t.value").alias("z_score"),
        F.when(F.col("t.value") > 0, "ABOVE train mean").otherwise("BELOW train mean").alias("direction"),
    )


def explain_linear(
    features: DataFrame, weights: Mapping[str, float], means: DataFrame, keep: Sequence[str],
    intercept: float = 0.0, k: int = 10,
) -> DataFrame:
    """Exact attributions of a linear model in log-odds: weight x (value - training mean).

    ``means`` is one row with a ``mean_<feature>`` column each. Adds the base value, which the
    attributions of all features sum up from, and the bar width relative to the largest one.
    """
    joined = features.crossJoin(F.broadcast(means))
    shift = {n: F.lit(w) * (F.col(n) - F.col(f"mean_{n}")) for n, w in weights.items()}
    base = sum((F.lit(w) * F.col(f"mean_{n}") for n, w in weights.items()), F.lit(intercept))
    top = _ranked(shift, {"feature_value": {n: F.col(n) for n in weights}}, k)
    rows = joined.select(*keep, base.alias("base_value"), top.alias("top"))
    widest = F.greatest(-F.get("top", F.lit(0))["key"], F.lit(1e-9))
    flat = rows.select(*keep, "base_value", widest.alias("widest"), F.posexplode("top").alias("rank", "t"))
    return flat.select(
        *keep, "base_value", (F.col("rank") + 1).alias("rank"), F.col("t.name").alias("name"),
        F.col("t.value").alias("attribution"), F.col("t.feature_value").alias("feature_value"),
        F.when(F.col("t.value") > 0, "MAL").otherwise("BEN").alias("direction"),
        F.round(F.abs("t.value") / F.col("widest") * 100, 1).alias("bar_width_pct"),
    )


# --- attributions of a fitted URL model ---------------------------------------------------

def gram_index(model: PipelineModel, grams: DataFrame, bits: int) -> DataFrame:
    """``gram, cell, weight``: the hash cell of every distinct piece seen, with its fitted coefficient."""
    linear = model.stages[-1]
    spark, weights = grams.sparkSession, linear.coefficients.toArray()[: 1 << bits]
    # bounded by the number of cells, a parameter of the model
    table = spark.createDataFrame([(int(i), float(weights[i])) for i in weights.nonzero()[0]], "cell int, weight double")
    vectors = HashingTF(inputCol="_grams", outputCol="_vector", numFeatures=1 << bits, binary=True).transform(
        grams.select("gram").distinct().withColumn("_grams", F.array("gram")))
    cell = F.udf(lambda v: int(v.indices[0]), "int")  # once per distinct piece
    return vectors.select("gram", cell("_vector").alias("cell")).join(F.broadcast(table), "cell", "left").select(
        "gram", "cell", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def explain_url_model(
    model: PipelineModel, df: DataFrame, stats: DataFrame, keep: Sequence[str], url: str = "url", bits: int = 18,
) -> DataFrame:
    """``*keep, kind, name, position, attribution``: what moves the log-odds of a fitted URL model, per row.

    Kinds are ``base`` (the intercept), ``lexical`` (coefficient x standardised value, one row per feature)
    and ``piece`` (a coefficient per hash cell that the URL's pieces meet, named by its first piece, with
    that piece's place). The attributions of a row add up to the model's log-odds. ``keep`` must identify
    a row.
    """
    cleaned = df.select(*keep, strip(F.col(url)).alias(url))
    return explain_lexical(model, FE.lexical_features(cleaned, url, (*keep, url)), stats, keep, url, bits)


def explain_lexical(
    model: PipelineModel, lexical: DataFrame, stats: DataFrame, keep: Sequence[str], url: str = "url", bits: int = 18,
) -> DataFrame:
    """:func:`explain_url_model` of stripped URLs whose lexical features are there already.

    URLs are spread by their key before they are taken apart; pieces that meet a small index are then grouped where they are.
    """
    linear = model.stages[-1]
    tail = linear.coefficients.toArray()[1 << bits:]
    cleaned = spread_by(lexical.select(*keep, F.col(url).alias("_url")), *keep)
    z = FE.normalize_features(lexical, stats, keep)

    def item(kind: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(None).cast("int").alias("position"), value.alias("attribution"))

    named = F.array(item("base", "base", F.lit(float(linear.intercept))),
                    *(item("lexical", n, F.col(n) * float(w)) for n, w in zip(K.LEXICAL_FEATURES, tail, strict=True)))
    whole = z.select(*keep, F.inline(named))
    pieces = None
    for n in URL_NGRAMS:
        part = cleaned.select(*keep, F.posexplode(P.char_ngrams(F.col("_url"), n)).alias("position", "gram"))
        pieces = part if pieces is None else pieces.unionByName(part)
    index = cut_lineage(gram_index(model, pieces.select("gram"), bits))
    weighed = lookup_join(pieces, index, "gram")
    first = weighed.groupBy(*keep, "cell").agg(
        F.min(F.struct("position", "gram")).alias("_p"), F.first("weight").alias("attribution"))
    cells = first.where("attribution <> 0").select(
        *keep, F.lit("piece").alias("kind"), F.col("_p.gram").alias("name"), F.col("_p.position").alias("position"), "attribution")
    return whole.unionByName(cells)


def block_weights(
    df: DataFrame, weights: DataFrame, keep: Sequence[str], url: str = "url", n: int = 3
) -> DataFrame:
    """Sum of the piece weights per block of four characters of each URL.

    ``weights`` has one row per gram. Pieces like ``://`` occur in every URL, so the lookup must
    stand hot keys. URLs are spread by their key before they are taken apart; with weights small
    enough to broadcast, the pieces are then summed where they are.
    """
    pieces = spread_by(df, *keep).select(*keep, url, F.posexplode(P.char_ngrams(F.col(url), n)).alias("position", "gram"))
    weighed = lookup_join(pieces, weights.select("gram", "weight"), "gram")
    block = F.floor(F.col("position") / BLOCK).cast("int")
    return weighed.groupBy(*keep, url, block.alias("block")).agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def top_blocks(blocks: DataFrame, keep: Sequence[str], url: str = "url", k: int = 5) -> DataFrame:
    """The k heaviest blocks of each URL with their text; equal weights go left to right."""
    item = F.struct((-F.col("weight")).alias("key"), F.col("block").alias("block"))
    grouped = blocks.groupBy(*keep, url).agg(
        F.slice(F.sort_array(F.collect_list(item)), 1, k).alias("top"))
    rows = grouped.select(*keep, url, F.posexplode("top").alias("rank", "t"))
    position = F.col("t.block") * BLOCK
    return rows.select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("t.block").alias("block"),
        position.alias("position"), F.substring(F.col(url), position + 1, F.lit(BLOCK)).alias("snippet"),
        (-F.col("t.key")).alias("weight"),
    )
