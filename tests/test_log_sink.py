"""The log sink gets every alert of a batch."""

import logging

from pyspark.sql import functions as F

from routeloom.sinks.alerts import log_sink


def test_all_alerts_are_logged(spark, caplog):
    severity = F.when(F.col("id") == 3, "critical").otherwise("warning")
    alerts = spark.range(2500).select("id", F.lit("leak").alias("type"), severity.alias("severity"), F.lit(65000).cast("bigint").alias("observed_asn"), F.lit("p").alias("peer"))
    with caplog.at_level(logging.WARNING, logger="routeloom.alerts"):
        log_sink()(alerts.orderBy(F.desc("id")), 0)
    assert [r.args[0] for r in caplog.records] == list(range(2500))
    assert [r.args[0] for r in caplog.records if r.levelno == logging.ERROR] == [3]
