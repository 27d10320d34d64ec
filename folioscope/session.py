"""Session factory: UTC, adaptive execution, shuffle partitions from the input's size."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of shuffle input that one partition should hold.
PARTITION_BYTES = 128 << 20


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Enough partitions for PARTITION_BYTES each, and at least one a core."""
    return max(cores, -(-input_bytes // PARTITION_BYTES))


def get_spark(name: str = "folioscope", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session with the settings that the operators expect; cluster settings win where given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
