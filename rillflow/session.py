"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "rillflow", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; without ``master`` the one that the cluster sets."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def streaming_settings(spark: SparkSession) -> None:
    """What stateful streams need in a session made elsewhere."""
    for key in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone"):
        spark.conf.set(key, SETTINGS[key])
