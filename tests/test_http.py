"""The HTTP answers over an engine's tables."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from helpers import ann, frame, wd

from routeloom import http
from routeloom.functions.prefix import parse_text
from routeloom.operators.alerts import Settings
from routeloom.schema import WATCHLIST
from routeloom.streaming.job import STATES, Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    watch = spark.createDataFrame([(*parse_text("198.18.0.0/15"), 64801)], WATCHLIST)
    engine = Engine(spark, str(tmp_path_factory.mktemp("engine")), Settings(), None, watch, versions=1)
    engine.process(frame(spark, [ann(0, 10, "198.18.0.0/15", [64900, 64801]), ann(1, 11, "198.18.0.0/15", [64900, 64999], peer="p2"), ann(2, 12, "198.18.0.0/15", [64900, 64999], peer="p3")]), 0)
    assert engine.next_seq(1) == 3
    engine.process(frame(spark, [wd(3, 13, "198.18.0.0/15")]), 1)
    engine.process(frame(spark, []), 2)
    return engine


def get(engine, target):
    status, _, body = http.answer(engine, target)
    return status, json.loads(body)


def test_answers(engine):
    status, view = get(engine, "/api/v1/prefixes/198.18.0.0%2F15")
    assert status == 200 and view["dominant_origin"] == 64999 and len(view["routes"]) == 2 and len(view["history"]) == 4
    assert get(engine, "/api/v1/prefixes/198.18.0.0/15")[1] == view
    assert get(engine, "/api/v1/prefixes/198.18.0.0")[0] == 400 and get(engine, "/api/v1/alerts?limit=x")[0] == 400 and get(engine, "/nothing")[0] == 404
    assert get(engine, "/api/v1/asns/64999x/prefixes")[1]["prefixes"] == [{"prefix": "198.18.0.0/15", "peer": "p2"}, {"prefix": "198.18.0.0/15", "peer": "p3"}]
    alerts = get(engine, "/api/v1/alerts?type=hijack&severity=warning")[1]["alerts"]
    assert [(a["severity"], a["observed_asn"], a["evidence"]["peer_asn"], a["evidence"]["len"]) for a in alerts] == [("critical", 64999, 1, 15)]
    stats = get(engine, "/api/v1/stats")[1]
    assert stats["engine"] == {"events": 4, "suppressed": 1} and stats["alerts"]["hijack"] == 1 and stats["rib"]["routes"] == 2
    assert "alerts_suppressed_total 1" in http.answer(engine, "/metrics")[2] and "<table" in http.answer(engine, "/")[2]


def test_old_versions_are_deleted(engine, spark):
    import os

    assert all(sorted(os.listdir(f"{engine.folder}/{t}")) == ["batch=1", "batch=2"] for t in STATES)
    assert sorted(os.listdir(f"{engine.folder}/events")) == ["batch=0", "batch=1", "batch=2"]


def test_server():
    server = http.server(None, 0, respond=lambda engine, target: (200, "text/plain", target))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x?y=1"
    assert urllib.request.urlopen(url).read() == b"/x?y=1"
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(url, data=b"z")
    assert e.value.code == 405
    server.shutdown()
