"""Far too many small files: size-tiered incremental compaction with an idempotent transaction journal.

The space of keys is cut into ranges, by a hash of columns that the keys fix; how many is decided once, from the
bytes that are there, and stands in the journal. All work is within ranges: a file counts as one slice for every
range it holds records of. Slices of similar size (one tier spans a factor of ``ratio``) are merged level by level
while a tier of a range holds ``min_merge``. What is then left beside the largest file of a range is folded into
it once it makes up a share of ``1 / fold`` of it, so a range ends as one file in which no key stands twice, and later
arrivals cost what they bring, not what is there. Every level is one transaction:

* ``journal/txn=N`` lists its inputs and the output of each, written before any data;
* ``data/txn=N`` holds the outputs, one file each;
* ``commits/txn=N`` lists the outputs with their true sizes; its ``_SUCCESS`` marker makes the transaction count.

A transaction without its marker never happened: a later run plans it again and overwrites what is left of it.
One with its marker is never run again, so a crash at any point neither loses nor doubles a record. A slice is
live if it came from outside or from a committed transaction and no committed transaction consumed it. Listings,
journals and plans are DataFrames throughout: millions of files never meet on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.common import lookup_join
from tidegrid.session import materialize

MB = 1 << 20
_LISTING = "file string, part int, bytes long"
_PLAN = "file string, part int, txn int, output string"
#: The name of the file of records and listings whose file is null.
_NAMELESS = "\0"
#: Bytes of a record where no file of known size tells.
_RECORD_BYTES = 100


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


@dataclass
class Compaction:
    """Compaction of keyed records below ``root``.

    ``records``: ``file`` STRING, the ``keys``, the ``order`` columns and any payload. ``listing``: ``file``,
    ``bytes`` of the files from outside; null or negative sizes count as 0. ``ranges_by`` are expressions whose
    values follow from the keys (default: the keys); records that share them share a range, so columns that the
    records of one small file have in common keep its slices few.

    Of records with equal keys the one greatest by ``order`` stays (nulls lowest). Files that the listing lacks are
    sized by the records of the others; files without records leave nothing. A file is read once: later
    changes under a name known to the journal are not seen. Null keys are ordinary values; a null file is one file of
    its own; no records give an empty result.
    """

    records: DataFrame
    listing: DataFrame
    root: str
    keys: list[str]
    order: list[str]
    ranges_by: list[Column] = field(default_factory=list)
    target_bytes: int = 128 * MB
    fan_in: int = 256
    min_merge: int = 4
    ratio: int = 4
    fold: int = 8
    base_bytes: int = 1024

    def __post_init__(self) -> None:
        self.spark = self.records.sparkSession
        self.columns = [c for c in self.records.columns if c not in ("file", "part")]
        self._ranges: int | None = None

    # -- journal ------------------------------------------------------------------------------------------

    def _at(self, kind: str, n: int) -> str:
        return f"{self.root}/{kind}/txn={n}"

    def _numbers(self, kind: str) -> list[int]:
        n = 0
        while _exists(self.spark, f"{self._at(kind, n)}/_SUCCESS"):
            n += 1
        return list(range(n))

    def committed(self) -> list[int]:
        """The numbers of the committed transactions, in order; they are consecutive."""
        return self._numbers("commits")

    def ranges(self) -> int:
        """The number of ranges, fixed by the first run."""
        if self._ranges is not None:
            return self._ranges
        at = f"{self.root}/layout"
        if not _exists(self.spark, f"{at}/_SUCCESS"):
            total = self.listing.agg(F.coalesce(F.sum(F.greatest("bytes", F.lit(0))), F.lit(0)).cast("long")).first()[0]
            self.spark.range(1).select(F.lit(max(1, -(-total // self.target_bytes))).cast("int").alias("ranges")).write.mode("overwrite").parquet(at)
        self._ranges = self.spark.read.schema("ranges int").parquet(at).first()[0]
        return self._ranges

    def _outside(self) -> DataFrame:
        """The records from outside with the range each belongs to."""
        by = self.ranges_by or [F.col(f"`{c}`") for c in self.keys]
        part = F.pmod(F.xxhash64(*by), F.lit(self.ranges())).cast("int")
        return self.records.withColumn("file", F.coalesce("file", F.lit(_NAMELESS))).withColumn("part", part).select("file", "part", *self.columns)

    def _take_listing(self) -> None:
        """Add the slices of files that the journal does not know yet."""
        runs = self._numbers("sources")
        rows = self._outside().select("file", "part")
        if runs:
            known = self._slices("sources", runs).select("file").distinct()
            rows = rows.join(known, "file", "left_anti")
        slices = materialize(rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n")), "slices")
        sizes = self.listing.groupBy(F.coalesce(F.col("file").cast("string"), F.lit(_NAMELESS)).alias("file")).agg(F.sum(F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0))).cast("double").alias("b"))
        whole = slices.groupBy("file").agg(F.sum("n").alias("all")).join(sizes, "file", "left")
        # Files of unknown size are taken to have records as large as the others.
        usual = whole.where(F.col("b").isNotNull()).agg(F.coalesce(F.sum("b") / F.sum("all"), F.lit(float(_RECORD_BYTES))).alias("usual"))
        share = F.coalesce(F.col("b") / F.col("all"), F.col("usual")) * F.col("n")
        slices.join(whole, "file").join(F.broadcast(usual)).select("file", "part", share.cast("long").alias("bytes")).write.mode("overwrite").parquet(self._at("sources", len(runs)))

    def _slices(self, kind: str, numbers: list[int], schema: str = _LISTING) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[self._at(kind, n) for n in numbers])

    def live(self) -> DataFrame:
        """(``file``, ``part``, ``bytes``, ``txn``) of every live slice; ``txn`` -1 for those from outside."""
        made = self._slices("sources", self._numbers("sources"), _LISTING + ", txn int").withColumn("txn", F.lit(-1))
        txns = self.committed()
        if not txns:
            return made
        made = made.unionByName(self._slices("commits", txns, _LISTING + ", txn int"))
        return made.join(self._slices("journal", txns, "file string, part int"), ["file", "part"], "left_anti")

    def _contents(self, plan: DataFrame, txns: list[int]) -> DataFrame:
        """The records of the slices in ``plan``, which are of the transactions ``txns``, with their output."""
        rows = None
        for n in txns:
            if n < 0:
                part = self._outside()
            else:
                schema = self._outside().schema
                part = self.spark.read.schema(schema).parquet(self._at("data", n)).select(*schema.names)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self._outside().limit(0)
        return lookup_join(rows, plan.select("file", "part", "output"), ["file", "part"])

    # -- transactions -------------------------------------------------------------------------------------

    def _plan(self, txn: int, live: DataFrame) -> DataFrame:
        """The merges of one level: due tiers of each range; in ranges without any, the fold if it is due."""
        size = F.greatest(F.col("bytes"), F.lit(1)) / F.lit(self.base_bytes)
        tier = F.greatest(F.ceil(F.log2(size) / F.log2(F.lit(float(self.ratio)))), F.lit(0)).cast("int")
        live = live.withColumn("tier", F.when(F.col("bytes") < self.target_bytes // 2, tier).otherwise(-1))
        tiers = live.groupBy("part", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.max(F.when(F.col("txn") >= 0, F.col("bytes"))).alias("base"))
        merges = F.greatest(F.ceil(F.col("n") / self.fan_in), F.ceil(F.col("b") / self.target_bytes), F.lit(1)).cast("int")
        tiers = tiers.withColumn("m", F.when((F.col("tier") >= 0) & (F.col("n") >= self.min_merge), merges))
        ranges = tiers.groupBy("part").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("base").alias("base"), F.count("m").alias("due"))
        folds = ranges.where((F.col("due") == 0) & (F.col("base").isNull() | ((F.col("n") > 1) & ((F.col("b") - F.col("base")) * self.fold >= F.col("base")))))
        # Adaptive execution sees how large these are: few tiers and ranges are broadcast, a hot tier is split.
        dealt = live.join(tiers.where(F.col("m").isNotNull()).select("part", "tier", "m"), ["part", "tier"])
        dealt = dealt.withColumn("output", F.concat_ws("-", F.lit(str(txn)), "part", "tier", F.pmod(F.xxhash64("file"), F.col("m"))))
        folded = live.join(folds.select("part"), "part").withColumn("output", F.concat_ws("-", F.lit(str(txn)), "part", F.lit("whole")))
        return dealt.select("file", "part", "txn", "output").unionByName(folded.select("file", "part", "txn", "output"))

    def _merged(self, rows: DataFrame, by: list[str]) -> DataFrame:
        payload = [c for c in rows.columns if c not in (*by, *self.order)]
        newest = F.max_by(F.struct(*payload, *self.order), F.struct(*self.order))
        return rows.groupBy(*by).agg(newest.alias("_r")).select(*by, "_r.*")

    def _commit(self, txn: int, outputs: DataFrame) -> None:
        outputs.coalesce(1).write.mode("overwrite").parquet(self._at("commits", txn))

    def _level(self, txn: int) -> bool:
        self._plan(txn, materialize(self.live(), "live")).write.mode("overwrite").parquet(self._at("journal", txn))
        plan = self.spark.read.schema(_PLAN).parquet(self._at("journal", txn))
        txns = [r[0] for r in plan.select("txn").distinct().collect()]  # a handful
        if not txns:
            return False
        # An output is at most about a target size, so its rows are one task's work; equal keys meet in it.
        rows = self._contents(plan, txns).drop("file").repartition("output")
        merged = self._merged(rows, ["output", "part", *self.keys]).withColumn("file", F.col("output"))
        merged.write.mode("overwrite").partitionBy("output").parquet(self._at("data", txn))
        out = self.spark.read.schema("file string, part int").parquet(self._at("data", txn)).select("file", "part", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        self._commit(txn, out.distinct().groupBy("file", "part").agg(F.sum("size").cast("long").alias("bytes")))
        return True

    def run(self) -> DataFrame:
        """Run every level that is due; return :meth:`read`. Safe to call again after any failure."""
        self._take_listing()
        while self._level(len(self.committed())):
            pass
        return self.read()

    def read(self) -> DataFrame:
        """The records, each key once: ranges of one file as they are, the newest of each key in ranges of several."""
        live = materialize(self.live(), "live")
        settled = live.groupBy("part").agg(((F.count(F.lit(1)) == 1) & (F.min("txn") >= 0)).alias("_whole"))
        marked = materialize(live.join(settled, "part").withColumn("output", F.col("_whole").cast("string")), "live")
        txns = {w: [r["txn"] for r in marked.where(F.col("_whole") == w).select("txn").distinct().collect()] for w in (True, False)}
        out = self._contents(marked.where("_whole"), txns[True]).select(*self.columns)
        if txns[False]:
            out = out.unionByName(self._merged(self._contents(marked.where(~F.col("_whole")), txns[False]).select(*self.columns), self.keys).select(*self.columns))
        return out

    def files(self) -> DataFrame:
        """(``txn``, ``file``, ``part``, ``bytes``) of the live slices."""
        return self.live().select("txn", "file", "part", "bytes")

    def vacuum(self) -> int:
        """Delete the outputs that later transactions consumed; the number of them. Not beside readers of an earlier state."""
        alive = {r["file"] for r in self.live().where(F.col("txn") >= 0).select("file").distinct().toLocalIterator()}
        gone = 0
        for n in self.committed():
            fs, p = _path(self.spark, self._at("data", n))
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = s.getPath().getName()
                if name.startswith("output=") and name.removeprefix("output=") not in alive:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone


def point_records(points: DataFrame, files: DataFrame, hash_of: Column, resolution_of: Column) -> tuple[DataFrame, DataFrame, list[Column]]:
    """``records``, ``listing`` and ``ranges_by`` of a :class:`Compaction` from rollup points and the table of their files."""
    written = files.select(F.col("file_id").alias("_fid"), F.col("written_at").alias("file_written"))
    written = written.groupBy("_fid").agg(F.max("file_written").alias("file_written"))
    p = lookup_join(points.withColumn("_fid", F.col("file_id")), written, ["_fid"], "left")
    records = p.select(F.col("file_id").cast("string").alias("file"), hash_of.alias("series_hash"), resolution_of.alias("resolution"), "ts", "metric", "labels", "v_min", "v_max", "v_sum", "v_count", "v_first", "v_last", "file_written", F.col("file_id").alias("file_source"))
    listing = files.select(F.col("file_id").cast("string").alias("file"), F.col("size_bytes").cast("long").alias("bytes"))
    # A small file holds points of one series and a short time: few slices, and no series is one range.
    return records, listing, [F.col("series_hash"), F.col("resolution"), F.expr("ts div 86400000")]
