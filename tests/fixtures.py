"""Events around the edges of every window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F


def boundary_fixture(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """23 text rows around the edges of every window, for tests."""
    # Account, time, action, size, and creation time when it is not five minutes earlier.
    day, hour = timedelta(days=1), timedelta(hours=1)
    rows = [
        (1, datetime(2023, 10, 10, 12), "increase", "10000", None),
        (2, datetime(2023, 10, 15, 12), "increase", "5000", None),
        (1, datetime(2023, 11, 16, 12), "increase", "10000", None),
        (2, datetime(2023, 12, 1, 12), "increase", "5000", None),
        (3, datetime(2024, 1, 3, 12), "increase", "1200", None),
        (4, datetime(2024, 2, 7, 12), "increase", "2000", None),
        (5, datetime(2024, 3, 20, 12), "collateral", "0", None),
        (6, datetime(2024, 3, 25, 12), "increase", "500", None),
        (7, datetime(2024, 3, 20, 13), "cancel", "100", None),
        (8, start, "increase", "700", None),
        (9, datetime(2023, 11, 20, 12), "liquidation", "400", None),
        (1, end + hour, "increase", "800", None),
        (2, end + 2 * day, "increase", "900", None),
        (1, end + 23 * day + hour, "increase", "200", None),
        (1, end + 24 * day + hour, "increase", "300", None),
        (2, end + 25 * day, "liquidation", "400", None),
        (3, end + 23 * day, "decrease", "500", None),
        (4, end + 24 * day, "increase", "200", end - day),
        (6, end + 30 * day, "increase", "200", None),
        (7, end + 23 * day, "increase", "300", None),
        (8, end + 29 * day + 23 * hour, "increase", "200", None),
        (1, end + 53 * day, "increase", "200", None),
        (6, end + 59 * day, "increase", "300", None),
    ]

    def text(value: datetime) -> str:
        return value.isoformat() + "Z"

    plain = [(i, f"{a:040x}", text(ts), action, size, text(made or ts - timedelta(minutes=5)))
             for i, (a, ts, action, size, made) in enumerate(rows)]
    base = spark.createDataFrame(plain, "i int, account string, timestamp string, action string, "
                                        "size_delta_usd string, order_created_at string")

    def key(prefix):
        return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit(prefix), F.col("i").cast("string")), 256))

    fee = F.when(F.col("action").isin("increase", "decrease"), "1.25")
    return base.select(
        F.lit("42161").alias("chain_id"), key("event-").alias("tx_hash"), F.lit("1").alias("log_index"),
        F.concat(F.lit("0x"), "account").alias("account"), key("order-").alias("order_key"),
        F.lit("0x" + "1" * 40).alias("market"), "timestamp", "action", F.lit("true").alias("success"),
        "size_delta_usd", fee.alias("position_fee_usd"), "order_created_at")
