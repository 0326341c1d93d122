"""Tables that micro-batches keep up to date: snapshot plus deltas, and a bucketed history of URLs.

A batch only ever writes its own ``batch_id`` folder, with overwrite, so a replayed batch replaces
itself. Compaction folds the deltas of finished batches into a snapshot and publishes it by creating
one manifest file, which is atomic: readers take the newest manifest, that snapshot, and the deltas
behind it. Whatever a failed compaction leaves is never named by a manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERGES = {"sum": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}


class Folder:
    """The few file-system calls that the tables need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        folder = self._make(f"{self.path}/{below}" if below else self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def has(self, below: str) -> bool:
        return self._fs.exists(self._make(f"{self.path}/{below}"))

    def create(self, below: str, text: str) -> None:
        """Write a new file; an error if it is there."""
        out = self._fs.create(self._make(f"{self.path}/{below}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, below: str) -> str:
        source = self._fs.open(self._make(f"{self.path}/{below}"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def delete(self, below: str) -> None:
        self._fs.delete(self._make(f"{self.path}/{below}"), True)


class StateTable:
    """Current rows per key of an updating table.

    ``merges`` names how each value column of several batches becomes one (``sum``, ``max``, ``min``,
    ``bit_or``); without it the row of the newest batch stands. ``every`` deltas are folded into a snapshot.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], merges: Mapping[str, str] | None = None, every: int = 20,
    ):
        self.spark, self.keys, self.merges, self.every = spark, tuple(keys), dict(merges or {}), every
        self.folder = Folder(spark, path)

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names() if n.startswith("batch_id="))

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest one of batches before ``before``."""
        upto = [int(n.removesuffix(".json")) for n in self.folder.names("_manifest") if n.endswith(".json") and not n.startswith(".")]
        upto = [u for u in upto if before is None or u < before]
        return json.loads(self.folder.read(f"_manifest/{max(upto)}.json")) if upto else None

    def sources(self, before: int | None = None) -> tuple[str | None, list[int]]:
        """The snapshot and the deltas behind it that a reader opens."""
        known = self.manifest(before)
        start = known["upto"] if known else None
        deltas = [b for b in self.batches() if (start is None or b > start) and (before is None or b < before)]
        return (known["snapshot"] if known else None), deltas

    def read(self, before: int | None = None) -> DataFrame | None:
        """Rows per key, of all batches or of those before ``before``; None where nothing is stored."""
        snapshot, deltas = self.sources(before)
        parts = [self.spark.read.parquet(f"{self.folder.path}/{snapshot}")] if snapshot else []
        if deltas:
            paths = [f"{self.folder.path}/batch_id={b}" for b in deltas]
            parts.append(self.spark.read.option("basePath", self.folder.path).parquet(*paths))
        if not parts:
            return None
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        values = [c for c in rows.columns if c not in (*self.keys, "batch_id")]
        if self.merges:
            return rows.groupBy(*self.keys).agg(*(MERGES[self.merges[v]](v).alias(v) for v in values))
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("batch_id", *values)).alias("_s"))
        return newest.select(*self.keys, *(F.col(f"_s.{v}").alias(v) for v in values))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch; before that, fold finished batches when there are enough of them."""
        _, deltas = self.sources(batch_id)
        if len(deltas) >= self.every:
            self.compact(batch_id)
        rows.write.mode("overwrite").parquet(f"{self.folder.path}/batch_id={batch_id}")

    def compact(self, before: int) -> None:
        """Fold all batches before ``before``, which are finished, into a snapshot and publish it."""
        _, deltas = self.sources(before)
        if not deltas:
            return
        # of a merged row any batch it came from may stand for its age: deltas behind it are newer
        name = f"_snapshots/{uuid.uuid4().hex}"
        self.read(before).withColumn("batch_id", F.lit(deltas[-1])).write.parquet(f"{self.folder.path}/{name}")
        manifest = json.dumps({"upto": deltas[-1], "snapshot": name})
        if not self.folder.has(f"_manifest/{deltas[-1]}.json"):
            self.folder.create(f"_manifest/{deltas[-1]}.json", manifest)

    def vacuum(self) -> None:
        """Delete deltas and snapshots that the newest manifest no longer needs; only without other readers."""
        known = self.manifest()
        if known is None:
            return
        for b in self.batches():
            if b <= known["upto"]:
                self.folder.delete(f"batch_id={b}")
        for name in self.folder.names("_snapshots"):
            if f"_snapshots/{name}" != known["snapshot"]:
                self.folder.delete(f"_snapshots/{name}")


class UrlHistory:
    """Every URL ever stored, laid out by hash bucket, with a Bloom filter per bucket.

    A batch asks the filters first and opens only the buckets that may hold one of its URLs. Filters are
    words of 64 bits, merged by ``bit_or``; their size is fixed, and once they fill up, buckets are opened
    needlessly but results stay exact.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, words: int = 1 << 14, hashes: int = 4):
        self.spark, self.n_buckets, self.n_words, self.hashes = spark, buckets, words, hashes
        self.folder = Folder(spark, path)
        self.filters = StateTable(spark, f"{path}/_filters", ("bucket", "word"), {"bits": "bit_or"})
        self.opened: list[str] = []  #: folders that the last question read

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.n_buckets)).cast("int")

    def probes(self, urls: DataFrame) -> DataFrame:
        """``url, bucket, word, bit``: where a URL's bits are."""
        hashed = [F.xxhash64("url", F.lit(i)) for i in range(1, self.hashes + 1)]
        places = F.array(*(F.struct(
            F.pmod(h, F.lit(self.n_words)).cast("int").alias("word"),
            F.expr("1L").alias("one"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int").alias("at")) for h in hashed))
        spread = urls.select("url", self.bucket(F.col("url")).alias("bucket"), F.inline(places))
        return spread.select("url", "bucket", "word", F.expr("shiftleft(one, at)").alias("bit"))

    def paths(self, buckets: Iterable[int], before: int) -> list[str]:
        """Folders of these buckets in the seed and in earlier batches."""
        wanted = {f"bucket={b}" for b in buckets}
        homes = [n for n in self.folder.names() if n == "_stored" or (n.startswith("batch_id=") and int(n.split("=")[1]) < before)]
        return [f"{self.folder.path}/{home}/{n}" for home in sorted(homes) for n in self.folder.names(home) if n in wanted]

    def known(self, urls: DataFrame, before: int) -> DataFrame | None:
        """Those of ``urls`` (column ``url``, each once) that were stored before a batch; None if none can be."""
        self.opened = []
        filters = self.filters.read(before)
        if filters is None:
            return None
        hits = self.probes(urls).join(filters, ["bucket", "word"]).where("(bits & bit) <> 0")
        # two probes of a URL may meet the same bit; counting probes, not bits, keeps that right
        maybe = hits.groupBy("url", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == self.hashes)
        buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most all buckets
        self.opened = self.paths(buckets, before)
        if not self.opened:
            return None
        stored = self.spark.read.parquet(*self.opened).select("url").distinct()
        return maybe.select("url").join(stored, "url", "left_semi")

    def _mark(self, urls: DataFrame, batch_id: int) -> None:
        bits = self.probes(urls).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        self.filters.write(bits, batch_id)

    def seed(self, stored: DataFrame) -> None:
        """Take in an older table once; later calls find it done. It counts as batch -1."""
        if self.folder.has("_stored/_SUCCESS") and -1 in self.filters.batches():
            return
        urls = stored.select("url").where("url IS NOT NULL").distinct().withColumn("bucket", self.bucket(F.col("url")))
        urls.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/_stored")
        self._mark(self.spark.read.parquet(f"{self.folder.path}/_stored").select("url"), -1)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the new rows of a batch (column ``url``, each once) and mark them in the filters."""
        home = f"{self.folder.path}/batch_id={batch_id}"
        rows.withColumn("bucket", self.bucket(F.col("url"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(home)
        self._mark(self.spark.read.schema(rows.select("url").schema).parquet(home), batch_id)
