"""Pulls, marks and slices, workbooks, deciders on small cases."""

import io
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import deciders
from tarnlake.sources import pull, sync, xlsx


def test_marks_never_go_back():
    t = datetime(2024, 1, 1, tzinfo=UTC)
    s = sync.Stream(overlap_minutes=60, settle_minutes=5)
    assert sync.span(None, t, s) is None
    assert sync.span(t, t + timedelta(hours=2), s) == (t - timedelta(hours=1), t + timedelta(minutes=115))
    until = t + timedelta(hours=1)
    assert sync.next_mark(t, [t - timedelta(hours=3)], until, s, False) == t
    assert sync.next_mark(t, [t + timedelta(hours=9)], until, s, False) == until
    loose = sync.Stream(ordered=False)
    assert sync.next_mark(t, [t + timedelta(minutes=9)], until, loose, False) == t and sync.next_mark(t, [], until, loose, True) == until
    assert sync.due(5, t, t, {"a"}, {"b"}) and not sync.due(5, t, t, {"a"}, {"a"}) and sync.due(5, t, t + timedelta(hours=1), {"a"}, None)
    assert sync.whole_days(t + timedelta(hours=1), t + timedelta(days=2, hours=3)) == (t + timedelta(days=1), t + timedelta(days=2))


def test_slices_resume(spark):
    s = sync.slices(spark, "2024-01-01", "2024-01-10", 4)
    assert [(str(r["start"])[:10], str(r["end"])[:10]) for r in s.orderBy("start").collect()] == [("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-09"), ("2024-01-09", "2024-01-10")]
    ledger = spark.createDataFrame([("2024-01-01", "running", 1), ("2024-01-01", "done", 2), ("2024-01-05", "failed", 1)], "start string, status string, at int").withColumn("start", F.col("start").cast("timestamp"))
    assert sync.open_slices(s, ledger).count() == 2


def test_pull_reads_all_pages_of_all_slices(spark):
    def fetch(part, token):
        page = int(token or 0)
        rows = [{"id": f"{part['since'][:10]}-{page}", "at": part["since"], "n": 1.5, "ok": True, "who": {"value": 7, "display_value": "Ann"}, "tags": ["x"]}]
        return rows, None if page == 2 else str(page + 1)

    def endless(part, token):
        return [], "again"

    out = pull.pull(spark, fetch, "2024-01-01", "2024-01-04", 1, "id", "at", tasks=2)
    rows = out.collect()
    assert len(rows) == 9 and len({r["source_key"] for r in rows}) == 9
    assert rows[0]["payload"].startswith('{"at": ') and '"n": "1.5"' in rows[0]["payload"] and '"ok": "true"' in rows[0]["payload"] and '"who": "7", "who_display": "Ann"' in rows[0]["payload"]
    gone = spark.createDataFrame([("2024-01-01-0", "2024-01-01 00:00:00")], "source_key string, updated_at string")
    assert pull.merged(out, gone).filter("deleted").count() == 1
    with pytest.raises(Exception, match="don't end"):
        pull.pull(spark, endless, "2024-01-01", "2024-01-02", 1, "id", "at").collect()


def test_bounded_select_and_whole_days(spark, tmp_path):
    spark.range(1000).withColumn("at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert [r["id"] for r in pull.bounded_select(df, "at", "id", "2024-01-02", "2024-01-03", 10**9).collect()] == list(range(24, 48))
    with pytest.raises(ValueError):
        pull.bounded_select(df, "at", "id", "2024-01-02", "2024-01-03", 10)
    points = df.select(F.lit("s").alias("service"), "at", F.col("id").cast("double").alias("value"))
    days = pull.daily_points(points, "tool", "load", "u", "2024-01-03").orderBy("date").collect()
    assert [r["value"] for r in days] == [11.5, 35.5]


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>co</t></r><r><t>st</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>disk</t></is></c><c r="C2"><v>12.5</v></c></row><row><c r="C3" t="b"><v>1</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>name</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "x.xlsx").write_bytes(buffer.getvalue())
    got = xlsx.read_xlsx(spark, str(tmp_path), ["name", "cost", "none"]).collect()
    assert sorted(((r["name"], r["cost"], r["none"]) for r in got), key=str) == [("disk", "12.5", None), (None, "true", None)]
    assert xlsx.read_xlsx(spark, str(tmp_path), ["name"], sheet="B").count() == 0


def test_deciders_and_encoders(spark):
    df = spark.createDataFrame([(1, "disk full"), (2, None), (3, "link down down"), (4, "disk full")], "id int, t string")
    load = deciders.keyword_decider({"storage": ["disk"], "network": ["link", "down"]})
    got = {r["id"]: r for r in deciders.decide_table(df, "t", load, ["network", "storage"]).collect()}
    assert got[1]["answer"] == got[4]["answer"] == "storage" and got[3]["answer"] == "network" and got[2]["answer"] is None and abs(sum(got[3]["distribution"]) - 1) < 1e-9
    v = {r["id"]: r["v"] for r in df.select("id", deciders.encoder(deciders.hash_encoder(16))("t").alias("v")).collect()}
    assert v[1] == v[4] != v[3] and v[2] is None and abs(sum(x * x for x in v[3]) - 1) < 1e-6
