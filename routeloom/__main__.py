"""Command line: `rov DUMP PREFIX ASN`, `replay PATH [--query PREFIX]`, `serve --config FILE [--input FOLDER] --state FOLDER [--http]`.

Start it with spark-submit or python -m routeloom. serve takes the live feed's landed lines before archived dumps, and
those before the stub.
"""

from __future__ import annotations

import argparse
import json
from threading import Thread

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .http import server
from .operators.alerts import Settings
from .sinks.alerts import log_sink, table_sink, webhook_sink
from .sources import config, fixture, live, mrt, vrp
from .streaming.job import Engine


def session() -> SparkSession:
    return SparkSession.builder.appName("routeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def replay(spark: SparkSession, path: str, query: str | None = None) -> dict:
    """Counts of a dump, the table it leaves, and the view of a prefix."""
    records = mrt.read_records(spark, path)
    events = mrt.with_seq(mrt.events(records))
    out = {"replay": mrt.replay_stats(records).first().asDict(), "rib": api.rib.stats(events).first().asDict()}
    if query:
        out["prefix"] = api.prefix_view(events, query)
    return out


def stream_of(spark: SparkSession, c: config.Config, landed: str | None) -> DataFrame | None:
    """The configured stream of events with file and place (rec_no and item for lines); None means the stub."""
    if c.live_enabled and landed:
        # a landed file is a batch of lines; their order within it is their number
        lines = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", 16).text(landed).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("rec_no", "value"))
        events = live.parse_lines(lines.withColumn("rec_no", F.col("rec_no").cast("bigint")), order=("file", "rec_no"))
        return live.feed_filter(events, c.live_host, c.live_prefix).drop("host")
    if c.mrt_file:
        return mrt.events(mrt.read_records(spark, c.mrt_file, streaming=True))
    return None


def serve(spark: SparkSession, c: config.Config, state: str, landed: str | None = None, once: bool = False, http: bool = False):
    settings = Settings(c.baseline_window, c.spike_window, c.spike_factor, c.spike_min, relationships=c.relationships())
    vrps = vrp.load(spark, c.vrp_file).cache() if c.vrp_file else None
    sinks = (log_sink(), *((table_sink(c.alert_table),) if c.alert_table else ()), *((webhook_sink(c.webhook_url),) if c.webhook_url else ()))
    engine = Engine(spark, state, settings, vrps, fixture.watchlist(spark, c.watch), sinks)
    if http:
        Thread(target=server(engine, c.api_port).serve_forever, daemon=True).start()
    stream = stream_of(spark, c, landed)
    if stream is None:
        engine.process(api.stub_events(spark), 0)
        return engine

    def process(batch: DataFrame, n: int) -> None:
        if "place" not in batch.columns:  # lines: events are counted within their file
            order = Window.partitionBy("file").orderBy("rec_no", "item")
            batch = batch.withColumn("place", F.row_number().over(order).cast("bigint") - 1).drop("rec_no", "item")
        engine.process(mrt.with_seq(batch, engine.next_seq(n)), n)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{state}/checkpoint")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    query.awaitTermination()
    return engine


def main() -> None:
    parser = argparse.ArgumentParser(prog="routeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("rov")
    one.add_argument("dump"), one.add_argument("prefix"), one.add_argument("asn", type=int)
    two = commands.add_parser("replay")
    two.add_argument("path"), two.add_argument("--query", "-q")
    three = commands.add_parser("serve")
    three.add_argument("--config", "-c", required=True), three.add_argument("--state", required=True), three.add_argument("--input"), three.add_argument("--once", action="store_true"), three.add_argument("--http", action="store_true")
    a = parser.parse_args()
    spark = session()
    if a.command == "rov":
        print(api.rov(vrp.load(spark, a.dump), a.prefix, a.asn))
    elif a.command == "replay":
        print(json.dumps(replay(spark, a.path, a.query), indent=2, default=str))
    else:
        serve(spark, config.load(a.config), a.state, a.input, a.once, a.http)


if __name__ == "__main__":
    main()
