"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "paperwire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # State of the streaming jobs lives on disk, not on the heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a session that names none (a local test) gets a temporary one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.environ.get("PAPERWIRE_LOCAL_FOLDER") or tempfile.mkdtemp(prefix="paperwire-")
    os.environ["PAPERWIRE_LOCAL_FOLDER"] = folder
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back.

    For a result that several later steps read: it is computed once, and a lost executor
    costs a re-read instead of the computation.
    """
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def placed(rows: DataFrame, name: str) -> DataFrame:
    """Add the file and row number that a row was read from, the same whenever a task is repeated.

    Rows that do not come straight from files are written once first.
    """
    def read(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))
        return df.select("*", place.alias(name))

    try:
        found = read(rows)
        found.schema  # noqa: B018  resolves the columns
        return found
    except PySparkException:
        return read(write_once(rows, "rows"))
