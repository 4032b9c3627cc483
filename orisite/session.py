"""Session settings the plans rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every plan here is written for.
PLAN_CONF = {
    # Adaptive execution: runtime broadcast of small sides, skew split, partition coalescing.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins and groups on (residue key, siteid) or (residue key, atomname) reuse the
    # residue-key partitioning instead of shuffling all atoms again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A bucket is what one task should hold, whatever its file's size: buckets are never packed into one task.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    # Many small structure files: pack more of them into one read task.
    "spark.sql.files.openCostInBytes": str(1 << 20),
    # A generated method above 8,000 bytes of code is never compiled by the JVM; such stages run operator by
    # operator instead, whose expressions are split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Arrow for the (small) results handed to pandas.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_plan_conf(spark: SparkSession) -> SparkSession:
    for k, v in PLAN_CONF.items():
        spark.conf.set(k, v)
    return spark


def is_local(spark: SparkSession) -> bool:
    """All tasks run on this machine, in this process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "orisite") -> SparkSession:
    """A local session for tests and the benchmark."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("ORISITE_DRIVER_MEMORY", "16g")))
    for k, v in PLAN_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).  A local session that
    names none (tests) gets a fresh private folder; a cluster must name one, since a folder of
    one machine cannot be read by the others."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="orisite-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


#: Session setting with the number of buckets of stage tables; see ``Materializer``.
BUCKETS_CONF = "spark.orisite.buckets"


def dealt_by(df: DataFrame, n: int, columns: list[str]) -> bool:
    """Whether the plan of ``df`` deals its rows into ``n`` partitions by the hash of ``columns``, as buckets are."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.inputPlan()
    found = [plan.outputPartitioning()]
    while found:
        p = found.pop()
        kind = p.getClass().getSimpleName()
        if kind == "PartitioningCollection":
            found += [p.partitionings().apply(i) for i in range(p.partitionings().length())]
        elif kind == "HashPartitioning" and p.numPartitions() == n:
            by = p.expressions()
            if [by.apply(i).toString().split("#")[0] for i in range(by.length())] == columns:
                return True
    return False


def lies_whole(df: DataFrame, column: str) -> bool:
    """Whether the rows of each value of ``column`` lie in one partition, dealt by its hash alone, so that what
    groups by it (and more) needs no shuffle: a table in buckets of it, or rows dealt by it before."""
    plan = df.groupBy(column).agg(F.count("*"))._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    found, sums = plan.outputPartitioning(), 0
    if found.getClass().getSimpleName() != "HashPartitioning":
        return False
    while sums < 2:
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" or plan.children().length() != 1:
            return False
        sums += kind == "HashAggregateExec"
        plan = plan.children().apply(0)
    return True


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` (last) as plain values for what follows: computed once a row, whatever uses them,
    and no filter on them is moved below, where it would compute them again."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*columns))))


class Materializer:
    """Writes stage results to the shared checkpoint folder and reads them back.

    This cuts the lineage (a lost executor re-reads a file instead of re-running every stage
    above it), lets the planner see real sizes, and keeps tables that are joined on the
    residue key *bucketed* on it, so the reads stay co-partitioned without another shuffle.

    ``buckets`` is the number of buckets, and so of tasks, of every bucketed stage: about the
    atom table's size over what one task should hold (128 MB, say).  It comes from the argument
    or from the setting ``spark.orisite.buckets``; only a local session may leave both out and
    gets one bucket for each core.  A bucketed table is one file for each bucket: rows that are not
    dealt to the buckets already are dealt before the write (each task would else write a file for each
    bucket).  A failing write fails the run.
    """

    _open: list["Materializer"] = []

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark = spark
        base = root or ensure_checkpoint_dir(spark)
        self.tag = uuid.uuid4().hex[:12]
        self.root = f"{base.rstrip('/')}/orisite-{self.tag}"
        buckets = buckets or spark.conf.get(BUCKETS_CONF, None)
        if buckets is None:
            if not is_local(spark):
                raise ValueError(f"pass buckets or set {BUCKETS_CONF}")
            buckets = spark.sparkContext.defaultParallelism
        self.buckets = int(buckets)
        self.tables: list[str] = []
        Materializer._open.append(self)

    def __call__(self, df, name: str, bucket_by: list[str] | None = None):
        path = f"{self.root}/{name}"
        if not bucket_by:
            df.write.mode("overwrite").parquet(path, compression="zstd")
            return self.spark.read.parquet(path)
        table = f"orisite_{self.tag}_{name}"
        self.tables.append(table)
        if not dealt_by(df, self.buckets, bucket_by):
            df = df.repartition(self.buckets, *bucket_by)
        (df.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(self.buckets, *bucket_by)
         .option("path", path).saveAsTable(table))
        return self.spark.table(table)

    def drop(self) -> None:
        """Remove this run's stage tables (catalog entries and files).  Call only once every
        DataFrame built on them has been consumed."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables[-1]}")
            self.tables.pop()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in Materializer._open:
            Materializer._open.remove(self)

    @classmethod
    def drop_all(cls) -> None:
        """Drop the stage tables of every materializer of this process that is still open."""
        while cls._open:
            cls._open[-1].drop()
