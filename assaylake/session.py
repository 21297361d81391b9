"""Session helpers; a cluster's own settings always win."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; shuffle partitions sized to the cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assaylake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may do without, on a folder of its own."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder, which a cluster needs to cut lineage")
    if not shared:
        shared = tempfile.mkdtemp(prefix="assaylake-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The state of a loop as written tables in the shared folder; a round's table goes once the next but one is written.

    A checkpoint would carry the estimated size of its plan on, which joins multiply round by round; a written table
    has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-3])
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)
