"""Session settings the jobs are tuned for, and the shared folder they write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings a deployment should start from; shuffle partitions and executor
# sizes stay with the cluster, since they depend on it.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Methods above HotSpot's limit would run interpreted; split those plans instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call sites are recorded per column expression, which doubles the time to build a query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Fleet state is one row per truck and never evicted: keep it off the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local[*]-style session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("coldwatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_folder(spark: SparkSession, job: str) -> str:
    """A new folder for one run of ``job``, in the storage all executors share.

    The cluster names that storage in ``spark.checkpoint.dir``.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{shared.rstrip('/')}/coldwatch/{job}-{uuid.uuid4().hex}"
