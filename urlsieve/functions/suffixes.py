"""Public-suffix rules of any number: plain (``co.uk``), wildcard (``*.ck``) and exception (``!www.ck``).

The rule that prevails for a host is its exception, else the one with the most labels; a host without a
rule has its last label as suffix, or none. Rules are read from the right, label by label:
:class:`SuffixRules` holds them per depth as hash sets inside the plan, one membership test per depth and
row and no join; :class:`SuffixTable` takes a table of rules and meets it by an equi-join on the tails of
the distinct hosts. Both can be given wherever a ``rules`` parameter is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rules that are held inside plans; a longer list is a table
INLINE_RULES = 20_000


def clean_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """``rule`` of the lines of a rule file: lower case, up to the first blank, without comments."""
    rule = F.lower(F.regexp_extract(F.ltrim(F.col(column)), "^(\\S*)", 1))
    return lines.select(F.regexp_replace(rule, "^\\.|\\.$", "").alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()


def read_rules(spark: SparkSession, path: str, unlisted: bool = True) -> SuffixRules | SuffixTable:
    """Rules of a file, held inside plans while they are few."""
    rules = clean_rules(spark.read.text(path))
    first = [r["rule"] for r in rules.limit(INLINE_RULES + 1).collect()]
    return SuffixRules(first, unlisted) if len(first) <= INLINE_RULES else SuffixTable(rules, unlisted)


def tail(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


class SuffixRules:
    """A list of rules inside the plan."""

    def __init__(self, rules: Iterable[str], unlisted: bool = True):
        self.unlisted = unlisted
        #: by kind and number of labels of what is compared
        self.sets: dict[tuple[str, int], list[str]] = {}
        for rule in sorted(set(rules)):
            kind, name = ("wild", rule[2:]) if rule.startswith("*.") else ("except", rule[1:]) if rule.startswith("!") else ("plain", rule)
            if "*" in name:
                raise ValueError(f"a wildcard stands only in front: {rule}")
            self.sets.setdefault((kind, name.count(".") + 1), []).append(name)

    def suffix(self, host: Column) -> Column:
        """The public suffix of a lower-case host; the empty string where there is none."""
        def within(kind: str, labels: int) -> Column:
            return tail(host, labels).isin(*self.sets.get((kind, labels), ()))

        chain = F.when(F.coalesce(host, F.lit("")) == "", F.lit(""))
        for kind, labels in sorted(self.sets):
            if kind == "except":
                chain = chain.when(within(kind, labels), tail(host, labels - 1))
        for labels in range(1 + max((n for _, n in self.sets), default=0), 0, -1):
            if ("plain", labels) in self.sets:
                chain = chain.when(within("plain", labels), tail(host, labels))
            if ("wild", labels - 1) in self.sets:
                chain = chain.when(within("wild", labels - 1) & (label_count(host) >= labels), tail(host, labels))
        return chain.otherwise(tail(host, 1) if self.unlisted else F.lit(""))

    def with_suffix(self, df: DataFrame, host: str, out: str) -> DataFrame:
        return df.withColumns({out: self.suffix(F.col(host))})


class SuffixTable:
    """A table of rules (column ``rule``) of any size."""

    def __init__(self, rules: DataFrame, unlisted: bool = True):
        self.unlisted = unlisted
        rule = F.col("rule")
        kind = F.when(rule.startswith("*."), "wild").when(rule.startswith("!"), "except").otherwise("plain")
        name = F.when(kind == "wild", F.substring(rule, 3, 1 << 20)).when(kind == "except", F.substring(rule, 2, 1 << 20)).otherwise(rule)
        self.rules = rules.select(name.alias("_tail"), kind.alias("_kind")).distinct()

    def with_suffix(self, df: DataFrame, host: str, out: str) -> DataFrame:
        """Distinct hosts meet the rules by each of their tails; the answer goes back to the rows."""
        from urlsieve.operators.lookups import lookup_join

        hosts = df.select(host).where(F.col(host) != "").distinct()
        n = label_count(F.col(host))
        tails = hosts.select(host, n.alias("_all"), F.explode(F.sequence(F.lit(1), n)).alias("_n")).withColumn(
            "_tail", F.expr(f"substring_index(`{host}`, '.', -_n)"))
        labels = F.when(F.col("_kind") == "wild", F.col("_n") + 1).when(F.col("_kind") == "except", F.col("_n") - 1).otherwise(F.col("_n"))
        met = tails.join(self.rules, "_tail").where("_kind <> 'wild' OR _n < _all")
        best = met.groupBy(host).agg(F.max(F.struct((F.col("_kind") == "except").alias("e"), labels.alias("n")))["n"].alias("_labels"))
        none = F.expr(f"substring_index(`{host}`, '.', -1)") if self.unlisted else F.lit("")
        found = F.when(F.coalesce(F.col(host), F.lit("")) == "", "").when(F.col("_labels").isNull(), none).otherwise(
            F.expr(f"substring_index(`{host}`, '.', -_labels)"))
        return lookup_join(df, best, host).withColumns({out: found}).drop("_labels")
