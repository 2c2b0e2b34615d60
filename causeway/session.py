"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "causeway", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the session is
    local; on a cluster executors on other machines could not read it. It goes when the
    program ends.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
    folder = tempfile.mkdtemp(prefix="causeway-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


_kept: ContextVar[tuple[list[str], ...]] = ContextVar("tables written", default=())


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of what ``materialize`` writes inside, so that it can be let go."""
    tables: list[str] = []
    token = _kept.set((*_kept.get(), tables))
    try:
        yield tables
    finally:
        _kept.reset(token)


def let_go(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several consumers follow or an iteration would grow the lineage. A written
    table survives lost executors, is computed exactly once, keeps column
    pruning and gives the optimizer true sizes for its join choices.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/causeway-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _kept.get():
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
