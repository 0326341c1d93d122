"""Secret scans: candidate spans per document, judged by how widely a value is owned.

Candidates are the three base kinds (fixed by the result contract) and long mixed tokens. The hash of
every value is aggregated by distinct owners and by distinct texts (a mirrored document counts once): a
value that several owners carry in several texts is a copied example, any other looks like a live credential. Base spans always stay; a mixed token
becomes a span only when its value looks live.

Built-in functions only. Candidates are extracted once; only documents that have some are stored, without
their texts, and the verdicts come back to the rows by a hash of the text. Texts move only where the
verdicts outgrow a broadcast, and then never those of a widely copied text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import fence, free_names
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import cut_lineage

# Fixed by the result contract: key word in either case, optional quote, sign, value.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
# The method's own candidates: runs of 20 or more token characters with both cases and a digit.
MIXED = "[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
BLOCK = 256  # matches that one growing list may hold
MAX_OWNERS = MAX_TEXTS = 1
FEW = 3  # owners and texts up to which the pipeline masks a value
MASK = "[SECRET]"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs (kind, s, e, value); those too short are dropped.

    A text is the pieces between matches and the matches in turn, so their lengths give the places. Many
    matches are taken in blocks, whose starts are summed up first: a list that grows by one match at a
    time would copy itself each time.
    """
    hits, gaps, values = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), group)
    parts = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), values.alias("value"))

    def width(p: Column) -> Column:
        return F.length(p["gap"]) + F.length(F.coalesce(p["hit"], F.lit("")))

    def add(state: Column, p: Column) -> Column:
        start, end = state["at"] + F.length(p["gap"]), state["at"] + width(p)
        one = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), p["value"].alias("value"))
        # the list grows only by kept matches; short ones (every run of hex letters in prose) cost no copy
        kept = F.when(F.length(p["value"]) >= least, F.concat(state["found"], F.array(one))).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    def walked(some: Column, start: Column) -> Column:
        step = F.struct(start.alias("at"), F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>").alias("found"))
        return F.aggregate(some, step, add, lambda s: s["found"])

    def blocked(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + width(p)))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda st, n: F.struct(
            (st["at"] + n).alias("at"), F.concat(st["all"], F.array(st["at"])).alias("all")), lambda st: st["all"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), lambda x: walked(x["b"], x["at"])))

    return F.when(F.size(gaps) <= BLOCK, walked(parts, F.lit(0))).otherwise(blocked(parts))


def candidates(text: Column) -> Column:
    """All candidate spans of a whole text, base kinds first; empty for null and empty texts."""
    none = F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>")
    body = F.coalesce(text, F.lit(""))
    # "{n,}" finds the same runs as "+" with a length test where the pattern is one greedy run
    long_access, long_hex = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
    assign = F.when(body.rlike(ASSIGN), spans(body, "assign", ASSIGN, 2, 8)).otherwise(none)
    access = F.when(body.contains("AKIA"), spans(body, "access", long_access, 0, 16)).otherwise(none)
    hexes = F.when(body.rlike(long_hex), spans(body, "hex", long_hex, 0, 32)).otherwise(none)
    mixed = F.when(body.rlike(MIXED), F.filter(
        spans(body, "mixed", MIXED, 0, 20),
        lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]"))).otherwise(none)
    return F.concat(assign, access, hexes, mixed)


def ownership(found: DataFrame, owner: str) -> DataFrame:
    """``_h, n_owners, n_texts, n_places`` per value hash of ``found`` (owner, _text_id, _spans).

    Owners and texts are made distinct per value before they are counted, with map-side combination, so a
    value that a third of all rows carry costs one row per task, owner and text.
    """
    each = found.select(F.col(owner).alias("_o"), F.col("_text_id").alias("_t"), F.explode("_spans").alias("_x")).select(
        "_o", "_t", F.xxhash64("_x.value").alias("_h"))
    return each.groupBy("_h").agg(
        F.count_distinct("_o").alias("n_owners"), F.count_distinct("_t").alias("n_texts"), F.count("*").alias("n_places"))


def with_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source",
    max_owners: int = MAX_OWNERS, max_texts: int = MAX_TEXTS,
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``secrets``: structs (kind, s, e, value, n_owners, n_texts, live).

    Places are code points, end exclusive, in order of start, then kind. ``live`` is true when at most
    ``max_owners`` distinct owners or at most ``max_texts`` distinct texts carry the value; a null owner counts
    as one owner, and copies of a text, whatever their keys, as one text. Null and empty
    texts have no spans. Rows that repeat, null keys included, get the same spans each.
    """
    keep = [c for c in docs.columns if c != "secrets"]
    (text_id,) = free_names(docs, "_text_id")
    # of a text's two hashes: candidates depend on the text alone
    number = F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.col(text))))
    owned = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    # the only extraction: stored are the few documents that have candidates, without their texts
    found = cut_lineage(fence(docs.select(
        number.alias("_text_id"), owned.alias("_owner"), candidates(F.col(text)).alias("_spans"))).where(F.size("_spans") > 0))
    table = ownership(found, "_owner")
    each = found.groupBy("_text_id").agg(F.first("_spans").alias("_spans")).select("_text_id", F.posexplode("_spans").alias("_at", "_x"))
    met = lookup_join(each.withColumn("_h", F.xxhash64("_x.value")), table, "_h")
    live = (F.col("n_owners") <= max_owners) | (F.col("n_texts") <= max_texts)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("_x.kind"))
    judged = met.withColumn("live", live).where("_x.kind <> 'mixed' OR live").groupBy("_text_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("_x.s").alias("s"), kind.alias("k"), "_at",
            F.struct("_x.kind", "_x.s", "_x.e", "_x.value", "n_owners", "n_texts", "live").alias("x")))).alias("_list"))
    # one text's candidates, in order of start, then kind
    dim = judged.select(F.col("_text_id").alias(text_id), F.transform("_list", lambda y: y["x"]).alias("secrets"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,value:string,n_owners:bigint,n_texts:bigint,live:boolean>>")
    rows = lookup_join(docs.select(*keep, number.alias(text_id)), dim, text_id)
    return rows.select(*keep, F.coalesce("secrets", none).alias("secrets"))


def listing(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from ``secrets``."""
    base = F.filter("secrets", lambda x: x["kind"] != "mixed")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return docs.select(
        key, *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listing(base), 256).alias("base_sha256"),
        listing(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda x: x["live"])).cast("long").alias("n_live"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every live span of ``text`` (the union of overlapping ones) by a mark; drop ``secrets``.

    Copied examples stay. Texts without live spans, null ones included, are unchanged.
    """
    (live,) = free_names(docs, "_live")
    step = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def cut(state: Column, x: Column) -> Column:
        inside = x["s"] < state["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(body, state["at"] + 1, x["s"] - state["at"]), F.lit(MASK)))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    whole = F.aggregate(F.col(live), step, cut, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body))))
    return docs.withColumn(live, F.filter("secrets", lambda x: x["live"])).withColumn(
        text, F.when(F.size(live) > 0, whole).otherwise(body)).drop(live, "secrets")
