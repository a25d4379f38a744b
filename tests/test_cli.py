import json

from test_sources import _dump

from routeloom import __main__ as cli
from routeloom.sources import config


def test_replay(spark, tmp_path):
    (tmp_path / "a.mrt").write_bytes(b"".join(_dump()))
    out = cli.replay(spark, str(tmp_path / "a.mrt"), "11.0.0.0/8")
    # the withdrawal comes from another peer, so both routes stay
    assert out["replay"]["updates"] == 3 and out["rib"]["routes"] == 2 and out["prefix"]["dominant_origin"] == 13335


def test_serve_sources(spark, tmp_path):
    (tmp_path / "a.mrt").write_bytes(b"".join(_dump()))
    c = config.parse(f"mrt_file = {tmp_path}/a.mrt\nwatch = 11.0.0.0/8 1\n")
    engine = cli.serve(spark, c, str(tmp_path / "s1"), once=True)
    assert [(r.type, r.observed_asn) for r in engine.alerts().collect()] == [("hijack", 13335)]
    line = lambda prefix, origin: json.dumps({"type": "ris_message", "data": {"timestamp": 5.0, "peer": "p", "peer_asn": "1", "path": [1, origin], "announcements": [{"next_hop": "1.1.1.1", "prefixes": [prefix]}]}})
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/1.txt").write_text(line("11.0.0.0/8", 1) + "\n\n" + line("11.0.0.0/8", 2) + "\n")
    c = config.parse("rislive_enabled = true\nwatch = 11.0.0.0/8 1\n")
    engine = cli.serve(spark, c, str(tmp_path / "s2"), str(tmp_path / "lines"), once=True)
    assert [(r.type, r.observed_asn) for r in engine.alerts().collect()] == [("hijack", 2)]
    assert cli.serve(spark, config.Config(), str(tmp_path / "s3")).alerts().count() == 0
