import os
from datetime import date

import duckdb
import pytest

from helixframe.llm import urlfilter

ENTRIES = [
    ("domain", "bad.com", date(2023, 1, 10), "add"), ("domain", "bad.com", date(2023, 2, 1), "remove"), ("domain", "bad.com", date(2023, 3, 1), "add"),
    ("host", "a.b.org", date(2023, 1, 1), "remove"), ("host", "a.b.org", date(2023, 1, 5), "add"), ("host", "a.b.org", date(2023, 1, 6), "add"),
    ("prefix", "c.net/x", date(2023, 1, 1), "add"), ("prefix", "c.net/x", date(2023, 1, 1), "remove"), ("domain", None, date(2023, 1, 1), "add"), ("host", "a.b.org", None, "add"),
]


def test_intervals(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, day date, action string")
    got = sorted(tuple(r) for r in urlfilter.intervals(entries).collect())
    forever = date(9999, 12, 31)
    assert got == [
        ("domain", "bad.com", date(2023, 1, 10), date(2023, 2, 1)), ("domain", "bad.com", date(2023, 3, 1), forever),
        ("host", "a.b.org", date(2023, 1, 5), forever), ("prefix", "c.net/x", date(2023, 1, 1), forever),
    ]


def test_as_of(spark, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, day date, action string")
    rows = [
        (1, "http://www.BAD.com/p", date(2023, 1, 9)), (2, "http://www.BAD.com:80/p", date(2023, 1, 10)), (3, "https://u@bad.com", date(2023, 1, 31)), (4, "https://bad.com", date(2023, 2, 1)),
        (5, "https://notbad.com/", date(2023, 4, 1)), (6, "http://a.b.org/", date(2023, 1, 5)), (7, "http://c.net/x/y?q#f", date(2023, 5, 5)), (8, "http://c.net/xy", date(2023, 5, 5)),
        (9, None, date(2023, 5, 5)), (10, "no url", date(2023, 5, 5)), (11, "http://bad.com", None), (7, "http://c.net/x/y?q#f", date(2023, 5, 5)), (12, "http://c.net/x" + "/y" * 4000, date(2023, 5, 5)),
    ]
    captures = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, fetch_day date, reason string")
    got = urlfilter.filter_captures(captures, entries, "page_id").collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    assert {r.page_id: r.reason for r in got if r.blocked} == {2: "domain:bad.com", 3: "domain:bad.com", 6: "host:a.b.org", 7: "prefix:c.net/x", 12: "prefix:c.net/x"}
    assert urlfilter.filter_captures(captures.where("false"), entries, "page_id").collect() == []
    same = spark.createDataFrame([(1, "http://bad.com", date(2023, 1, 12)), (1, "http://good.com", date(2023, 1, 12)), (1, "http://bad.com", date(2023, 2, 12)), (1, "http://bad.com", date(2023, 1, 12))], "page_id long, url string, fetch_day date")
    for most in (urlfilter.BROADCAST_ENTRIES, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_ENTRIES", most)
        got = urlfilter.filter_captures(same, entries, "page_id").collect()
        assert sorted((r.host, str(r.fetch_day), r.blocked, r.n_active) for r in got) == [("bad.com", "2023-01-12", True, 1)] * 2 + [("bad.com", "2023-02-12", False, 0), ("good.com", "2023-01-12", False, 0)]
    assert not any(r.blocked for r in urlfilter.filter_captures(captures, entries.where("false"), "page_id").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_as_duckdb(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = urlfilter.op2_url_interval_join(spark, folder)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{os.path.join(folder, 'pages.parquet')}'")
    want = con.execute(f"select {', '.join(names)} from ({urlfilter.ORACLE})").fetchall()
    ours = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(map(str, ours)) == sorted(map(str, want)) and any(r[names.index("blocked")] for r in ours)
