"""Session helpers.

Library operators never build a session themselves: callers pass ``spark``.
``get_spark`` exists for tests, ``bench.py`` and the driver entry point.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # remove checkpoint files once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # map-side merge of session windows before the shuffle on the keys
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def get_spark(
    master: str | None = None,
    app: str = "cadenza",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the house settings.

    ``spark.checkpoint.dir`` is taken from the environment/cluster config when
    present; only when nothing is configured (local tests) a fresh directory is
    made, so iterative operators can cut lineage with ``checkpoint()``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _configured_checkpoint_dir(spark):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3) for cluster runs")
        # local tests / bench only: a private folder on this machine
        local = tempfile.mkdtemp(prefix="cadenza-ckpt-")
        spark.conf.set("spark.checkpoint.dir", local)
        spark.sparkContext.setCheckpointDir(local)
    return spark


def _configured_checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        d = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key
        d = None
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    return None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Raises when unset: on a cluster a machine-local fallback would lose data
    when an executor is lost.
    """
    d = _configured_checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/cadenza-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):  # noqa: ANN001, ANN201 - DataFrame in, DataFrame out
    """Materialise ``df`` with a reliable ``checkpoint()`` in the shared
    checkpoint folder: later jobs start from it instead of replaying the plan
    (and survive losing the executors that computed it)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name):  # noqa: ANN001, ANN201 - DataFrame in, DataFrame out
    """Like :func:`cut_lineage` for tables that grow with the plays: compressed
    Parquet in the checkpoint folder, of which a consumer reads the columns it
    needs (a checkpoint holds whole rows as they are in memory)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
