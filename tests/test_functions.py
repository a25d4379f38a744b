import pytest
from pyspark.sql import functions as F

from routeloom.functions import aspath
from routeloom.functions.prefix import bit, covers, format_text, format_v4, parse, parse_address, parse_text, parse_v4

GOOD = {
    "100.77.201.9/11": "100.64.0.0/11", "198.18.7.255/31": "198.18.7.254/31", "172.29.0.0/0": "0.0.0.0/0", "203.0.113.77/32": "203.0.113.77/32", "198.19.255.1/007": "198.0.0.0/7",
    "fd12:3456:789a::/18": "fd12::/18", "fd00::beef/128": "fd00::beef/128", "fd00:0:0:7::/64": "fd00:0:0:7::/64", "FD00:AB::/32": "fd00:ab::/32", "::198.18.0.9/126": "::198.18.0.8/126", "fe80::/0": "::/0",
}
BAD = ["/", "198.18.0.1", "198.18.0.1/40", "198.18.0.1/+9", "198.18.0.1/9 ", "198.18.0/12", "198.18.0.1.5/12", "198.18.0.300/12", "198.018.0.1/12", "fd00::/200", "fd00:::1/20", "fd00::1::/20", "fd00::g/20", "nothing/9", "/9", "198.18.0.1/", None]


def test_prefix_texts():
    for text, want in GOOD.items():
        assert format_text(*parse_text(text)) == want
    assert all(parse_text(b) is None for b in BAD)


def test_prefix_columns(spark):
    rows = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string")
    both = rows.select("t", parse("t").alias("p"), parse_v4(F.col("t")).alias("q")).collect()
    for r in both:
        want = parse_text(r.t)
        assert (tuple(r.p) if r.p and r.p.family is not None else None) == want
        assert (tuple(r.q) if r.q else None) == (want if want and want[0] == 4 else None)
    v4 = rows.select(parse_v4(F.col("t")).alias("p")).where("p is not null").select(format_v4(F.col("p.hi"), F.col("p.len")).alias("f")).collect()
    assert {r.f for r in v4} == {w for w in GOOD.values() if ":" not in w}


def test_covers_and_bits(spark):
    cases = [("172.16.0.0/14", "172.18.9.0/27", True), ("172.16.0.0/14", "172.16.0.0/14", True), ("172.18.9.0/27", "172.16.0.0/14", False), ("172.16.0.0/14", "172.20.0.0/14", False), ("0.0.0.0/0", "fd00::/8", False),
             ("::/0", "fd00::/9", True), ("::/0", "172.16.0.0/14", False), ("fd00::/64", "fd00::/77", True), ("fd00:0:0:1::/64", "fd00::/77", False), ("fd00::/70", "fd00::400:0:0:0/70", False), ("0.0.0.0/0", "240.0.0.0/4", True)]
    rows = [(*parse_text(o), *parse_text(i), want) for o, i, want in cases]
    names = [f"{s}{c}" for s in ("o_", "i_") for c in ("family", "len", "hi", "lo")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n[-2:] in ('hi', 'lo') else 'int'}" for n in names) + ", want boolean")
    assert all(r.got == r.want for r in df.select("want", covers("o_", "i_").alias("got")).collect())
    p = spark.createDataFrame([parse_text("fd00::8001/128")], "family int, len int, hi bigint, lo bigint")
    assert [p.select(bit(F.col("hi"), F.col("lo"), F.lit(i))).first()[0] for i in (0, 5, 6, 7, 8, 63, 64, 111, 112, 127)] == [1, 1, 0, 1, 0, 0, 0, 0, 1, 1]


def test_addresses(spark):
    rows = spark.createDataFrame([(t,) for t in ("198.18.4.4", "FD00::0:9", "198.18.4", "fd00::1 fd00::2", "198.18.4.4/32", None)], "t string")
    assert [r[0] for r in rows.select(parse_address("t")).collect()] == ["198.18.4.4", "fd00::9", None, None, None, None]


@pytest.mark.parametrize("text, want", [("64901 64902", [64901, 64902]), ("", []), (f"9 {2**32 - 1}", [9, 2**32 - 1]), (f"9 {2**32}", None), ("64901;64902", None), ("-5", None), ("9" * 40, None), (" ".join(map(str, range(255))), list(range(255))), (" ".join(map(str, range(256))), None), ("  64901   7 ", [64901, 7])])
def test_path_parse(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(aspath.parse_path(F.col("t"))).first()[0] == want


def test_path_functions(spark):
    df = spark.createDataFrame([([64901, 23456, 23456], [4199990001, 4199990002]), ([5], [6, 7]), ([], []), ([5, 6], [])], "p array<bigint>, q array<bigint>")
    got = df.select(aspath.merge_as4(F.col("p"), F.col("q")), aspath.path_origin(F.col("p")), aspath.format_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [([64901, 4199990001, 4199990002], 23456, "64901 23456 23456"), ([5], 5, "5"), ([], 0, ""), ([5, 6], 6, "5 6")]
    live = spark.createDataFrame([(["64901", "64902", "[64903, 64904]"],), (["64901", "[64902]", "64903"],), ([],)], "p array<string>")
    assert [(r[0], r[1]) for r in live.select(*aspath.flatten_segments(F.col("p"))).collect()] == [([64901, 64902, 64903, 64904], True), ([64901, 64902, 64903], False), ([], False)]


def test_codes(spark):
    row = spark.range(1).select(
        aspath.type_code(F.lit("leak")), aspath.type_code(F.lit("nothing")), aspath.severity_code(F.lit("critical")), aspath.severity_code(F.lit(None).cast("string")),
        aspath.community(F.lit(65535), F.lit(65536 + 7)), aspath.origin_attribute(F.lit("IGP")), aspath.origin_attribute(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == (2, -1, 2, -1, 65535 << 16 | 7, 2, None)
