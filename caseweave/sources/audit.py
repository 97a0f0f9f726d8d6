"""Append-only audit table. Ids are random, order comes from the time stamp, so writers
need no lock and no running maximum."""
from __future__ import annotations

import json
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)


def audit_rows(spark: SparkSession, user_id: str, role: str, action: str, detail: Mapping) -> DataFrame:
    return spark.range(1).select(
        F.uuid().alias("audit_id"), F.current_timestamp().alias("ts"), F.lit(user_id).alias("user_id"),
        F.lit(role).alias("role"), F.lit(action).alias("action"),
        F.lit(json.dumps(detail, default=str)).alias("detail"),
    )


def append(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append audit rows to the table, which is partitioned by day."""
    rows.withColumn("day", F.col(ts).cast("date")).write.mode("append").partitionBy("day").parquet(path)


def write_audit(spark: SparkSession, path: str, user_id: str, role: str, action: str, detail: Mapping) -> bool:
    """Best effort: a failing audit write never breaks the caller."""
    try:
        append(audit_rows(spark, user_id, role, action, detail), path)
        return True
    except Exception as exc:  # noqa: BLE001
        log.warning("audit write failed: %s", exc)
        return False


def tail(audit: DataFrame, n: int = 50, ts: str = "ts", key: str = "audit_id") -> DataFrame:
    """The newest n rows; the id breaks ties."""
    return audit.orderBy(F.desc(ts), F.desc(key)).limit(n)
