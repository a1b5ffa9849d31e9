"""Requests read from files, exports and partial campaigns written by day."""
import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from baitline import constants as C
from baitline.operators import analytics as OA
from baitline.plans import queries as Q
from baitline.plans.investigate import investigate
from baitline.sources import requests as SR
from baitline.sources import sinks

SF = "/root/testdata/sf0.001"


def test_bad_lines_go_to_the_quarantine(spark, tmp_path):
    lines = ['{"text": "hello", "situation": "before_click"}',
             '{"msg_id": 7, "situation": "compromised", "image": "data:x", "extra": [1, {"a": 2}]}',
             '{"text": "cut off", "situation": "bef', "not json at all", '[1, 2]',
             '{"text": " \\u00a0", "situation": "before_click"}', '{"text": "x", "situation": "curious"}', '{"text": "x"}',
             '{"text": 5, "situation": "before_click"}', ""]
    (tmp_path / "a.json").write_text("\n".join(lines[:5]))
    (tmp_path / "b.json").write_text("\n".join(lines[5:]))
    accepted, rejected = SR.split_requests(SR.read_requests(spark, str(tmp_path)))
    ok = {r.msg_id: r for r in accepted.collect()}
    assert ok[7].text == "" and ok[7].demo_offline is False and ok[7].source.endswith("a.json")
    assert {r.text for r in ok.values()} == {"hello", "", "5"} and len(ok) == 3
    bad = rejected.collect()
    assert sum(r.reject_reason == SR.NOT_JSON for r in bad) == 3
    assert {r.record for r in bad if r.record} == {lines[2], lines[3], lines[4]}
    assert len(bad) == 6 and all(r.source.startswith("file:") for r in bad)


def test_requests_survive_a_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi"\n\\', "before_click", None, None, False), (2, None, "compromised", "data:y", "image/png", True)]
    df = spark.createDataFrame(rows, "msg_id long, text string, situation string, image string, mime_type string, demo_offline boolean")
    SR.write_requests(df, str(tmp_path / "r"))
    got = {r.msg_id: r for r in SR.read_requests(spark, str(tmp_path / "r")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[2].demo_offline and got[2].image == "data:y"


def test_text_files_are_whole_messages(spark, tmp_path):
    (tmp_path / "one.two.txt").write_text("line a\nline b\n")
    (tmp_path / "blank").write_text(" \n")
    accepted, rejected = SR.split_requests(SR.read_texts(spark, str(tmp_path)))
    assert [(r.name, r.text) for r in accepted.collect()] == [("one.two", "line a\nline b\n")]
    assert rejected.count() == 1


@pytest.fixture(scope="module")
def cases(spark):
    """Reports of messages over four days; users repeat, some ids are far apart, one is null."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        links = " ".join(rng.choice(["www.a.xyz", "https://paypal-x.live/p", "www.shop.com", "www.b.top/1"])
                         for _ in range(rng.randrange(0, 4)))
        rows.append((i, rng.choice([1, 2, 40_000, 70_000, -5, None]),
                     dt.datetime(2024, 3, 1 + rng.randrange(4), rng.randrange(24)), f"pay now {links}"))
    df = spark.createDataFrame(rows, "msg_id long, user_id long, ts timestamp, text string").withColumns({
        "situation": F.lit("before_click"), "image": F.lit(None).cast("string"), "demo_offline": F.lit(False)})
    return investigate(df).cache()


def test_days_merged_one_by_one_equal_one_pass(spark, cases, tmp_path):
    whole = sorted(map(tuple, OA.campaigns(cases).collect()))
    path = str(tmp_path / "days")
    for day in (3, 1, 4, 2, 1, 3):                                      # in any order, some days again
        sinks.write_campaign_days(OA.campaign_days(cases.where(F.dayofmonth("ts") == day)), path)
    days = spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))
    assert sorted(map(tuple, OA.merge_days(days).collect())) == whole
    some = OA.merge_days(days.where("day <= DATE'2024-03-02'"))
    assert sorted(map(tuple, some.collect())) == \
        sorted(map(tuple, OA.campaigns(cases.where(F.dayofmonth("ts") <= 2)).collect()))


def test_totals_count_a_user_once(spark, cases):
    days = OA.campaign_days(cases)
    got = {(r.level, r.domain_verdict, r.day): (r.n_links, r.n_users) for r in OA.campaign_totals(days).collect()}
    rows = [(r.user_id, r.ts, d.verdict) for r in cases.select("user_id", "ts", "domain_reports").collect()
            for d in r.domain_reports]
    users = lambda part: len({u for u, _, _ in part if u is not None})
    assert got[("all", None, None)] == (len(rows), users(rows))
    for v in {r[2] for r in rows}:
        part = [r for r in rows if r[2] == v]
        assert got[("verdict", v, None)] == (len(part), users(part))
    for d in {r[1].strftime("%Y-%m-%d") for r in rows}:
        part = [r for r in rows if r[1].strftime("%Y-%m-%d") == d]
        assert got[("day", None, d)] == (len(part), users(part))


def test_an_export_replaces_its_day_only(spark, cases, tmp_path):
    path = str(tmp_path / "exports")
    sinks.write_exports(cases, path)
    before = sorted(map(tuple, sinks.read_exports(spark, path).collect()))
    assert len(before) == 120 and json.loads(before[0][0])["report"]["verdict"] in ("High", "Medium", "Low")
    sinks.write_exports(cases.where("msg_id % 2 = 0").where(F.dayofmonth("ts") == 2), path)
    after = sorted(map(tuple, sinks.read_exports(spark, path).collect()))
    assert [r for r in after if r[1] != "2024-03-02"] == [r for r in before if r[1] != "2024-03-02"]
    assert 0 < sum(r[1] == "2024-03-02" for r in after) < sum(r[1] == "2024-03-02" for r in before)


def test_exports_are_compressed(spark, cases, tmp_path):
    path = str(tmp_path / "gzipped")
    sinks.write_exports(cases, path)
    files = [f for f in (tmp_path / "gzipped").rglob("part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) < sinks.read_exports(spark, path).selectExpr("sum(length(value))").first()[0] / 4


def test_days_hold_narrow_rows(spark, cases):
    """A day's row is (domain, day, user) with sums and bounds: no set of users of 4 KB a row."""
    days = OA.campaign_days(cases)
    assert "binary" not in dict(days.dtypes).values()
    plan = OA.campaign_totals(days)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "bitmap" not in plan
    assert days.count() <= cases.selectExpr("sum(size(domain_reports))").first()[0]


def test_cubes_name_their_margins(spark):
    from baitline.operators.lite import agreement_totals
    df = spark.createDataFrame([("High", "High"), ("High", "Low"), (None, "Low")], "verdict string, lite_verdict string")
    got = {(r.level, r.full_verdict, r.lite_verdict): (r.n_messages, r.n_agree) for r in agreement_totals(df).collect()}
    assert got[(3, None, None)][0] == 3 and got[(1, "High", None)] == (2, 1) and got[(1, None, None)][0] == 1
    assert got[(0, None, "Low")][0] == 1 and got[(2, None, "Low")][0] == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_links_are_extracted_once(spark):
    """The join form reads the written links: the events are scanned by the write alone."""
    plan = Q.domain_join_back(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "regexp_extract_all" not in plan


def test_stored_reports_hold_no_transcription(spark, msg_schema):
    rows = [(1, None, "before_click", "data:x;FIXTURE_BANK_SCREENSHOT", False),
            (2, "see https://user:pw@a.xyz/secret?id=1", "before_click", None, False)]
    rep = investigate(spark.createDataFrame(rows, msg_schema)).withColumns(
        {"user_id": F.lit(1), "ts": F.lit(dt.datetime(2024, 1, 1))})
    got = {r.msg_id: r for r in OA.case_files(rep).collect()}
    assert got[1].report.extracted_text is None and got[1].report.redacted_text
    assert [(l.domain, l.original) for l in got[2].report.links] == [("user", "user")]
    assert got[2].case_id != "case-2" and got[2].case_id.startswith("case-")
    assert C.PACKET_HEADER in got[2].report.report_draft
