"""Revisits against SQL on the tables, and against a plain search on odd records."""

from datetime import datetime, timedelta

from tessera.llm import warc
from tests.oracle import assert_same


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(warc.revisits(spark.read.parquet(f"{sf}/pages.parquet")), warc.ORACLE, sf, 100)


def test_odd_records(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [
        (1, "http://A.com:80/x/#f", t(0), 200, {"etag": "a", "x": "1", "content-length": "9"}, 5),
        (2, "https://www.a.com/x?utm_source=q", t(50), 304, {"etag": "W/a", "x": "2", "content-length": "0"}, 5),
        (3, "a.com/x", t(50), 304, {"last-modified": "d"}, 5),
        (4, "a.com/x", t(51), 200, None, 5),
        (5, "a.com/x", t(52), 304, None, 5),
        (6, "a.com/y?b=1&a=2", t(1), 304, {"etag": "a"}, 5),
        (7, None, t(0), 200, {"etag": "a"}, 5),
        (8, None, t(1), 304, {"etag": "a"}, 5),
        (9, "a.com/y?a=2&b=1", None, 200, {"etag": "b"}, 5),
        (9, "a.com/y?a=2&b=1", None, 200, {"etag": "b"}, 5),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, status int, headers map<string,string>, verdict int")
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert {k: (r.target_id, r.verdict) for k, r in got.items()} == {2: (1, "resolved"), 3: (1, "unproven"), 5: (4, "unproven"), 6: (9, "mismatch"), 8: (None, "missing")}
    assert got[2].merged == {"etag": "W/a", "x": "2", "content-length": "9"}
    assert warc.resolve(df.limit(0)).count() == 0
    wide = {r.record_id: (r.target_id, r.verdict) for r in warc.resolve(df, 10**9).collect()}
    assert wide == {k: (r.target_id, r.verdict) for k, r in got.items()}
