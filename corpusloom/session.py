"""Session defaults and the shared folder where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "corpusloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Stream state on disk: its keys need not fit in memory.
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local path
    would be lost with its executor, so an unset value is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table below the checkpoint root and read it back.

    It ends the lineage and outlives executors as a checkpoint does, and being columnar and of known
    size it lets later reads prune columns and pick joins.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table of as many buckets by ``keys`` as there are shuffle partitions, which can grow.

    Joins and groupings on the keys read it without moving it. The name lives in the session's catalog
    until the block that made it ends; the files stay below the checkpoint root.
    """

    def __init__(self, df: DataFrame, label: str, keys: list[str]):
        self.spark, self.keys = df.sparkSession, keys
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        self._write(df, "errorifexists", path=scratch_path(self.spark, label))

    def _write(self, df: DataFrame, mode: str, **options: str) -> None:
        # Rows are dealt by the buckets' own hash, so every task writes one file.
        dealt = df.repartition(self.buckets, *self.keys)
        writer = dealt.write.format("parquet").mode(mode).options(**options)
        writer.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def append(self, df: DataFrame) -> None:
        """Add rows; ``df`` may read the table as it was."""
        self._write(df, "append")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint root (stream state, stream output)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
