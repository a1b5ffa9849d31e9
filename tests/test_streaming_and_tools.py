"""Restart safety of the streaming jobs and the tool surface."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from baitline import constants as C
from baitline.functions import tools
from baitline.session import checkpoint_dir
from baitline.streaming import jobs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_stream_restart_is_idempotent(spark):
    base = os.path.join(checkpoint_dir(spark), "test-restart", uuid.uuid4().hex)
    first = jobs.run_stream_reports(spark, SF, base).count()
    # a restarted job resumes from its committed offsets: nothing is written twice
    assert jobs.run_stream_reports(spark, SF, base).count() == first > 0


def test_tool_names_and_aliases(spark):
    for name, alias in C.TOOL_ALIASES.items():
        assert tools.resolve_tool(name) is tools.resolve_tool(alias)
    with pytest.raises(ValueError):
        tools.resolve_tool("no_such_tool")
    r = spark.range(1).select(tools.call_tool("clean_text_pii", text=F.lit("mail a@b.com")).alias("r")).first().r
    assert r == "mail " + C.EMAIL_MASK


def test_every_tool_has_defaults_on_columns_and_in_sql(spark):
    tools.register_sql_functions(spark)
    for name, alias in C.TOOL_ALIASES.items():
        by_column = spark.range(1).select(tools.call_tool(name).alias("r")).first().r
        row = spark.sql(f"SELECT {name}() AS a, {alias}() AS b").first()
        assert row.a == row.b == by_column, name
    with pytest.raises(ValueError):
        tools.call_tool("redact_pii", words=F.lit("x"))


def test_table_functions_join_laterally(spark):
    tools.register_sql_functions(spark)
    spark.createDataFrame([(1, "pay at www.a.xyz or https://paypal-x.live/p"), (2, "hello"), (3, None)],
                          "id long, text string").createOrReplaceTempView("lateral_texts")
    rows = spark.sql("SELECT t.id, r.pos, r.domain, r.verdict FROM lateral_texts t, LATERAL link_reports(t.text) r "
                     "ORDER BY t.id, r.pos").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "a.xyz", "Medium"), (1, 2, "paypal-x.live", "High")]
    names = spark.sql("SELECT t.id, s.category FROM lateral_texts t, LATERAL text_signals(t.text) s").collect()
    assert (1, C.FINANCIAL) in {tuple(r) for r in names} and all(r.id == 1 for r in names)


def test_sql_functions_with_defaults(spark):
    tools.register_sql_functions(spark)
    row = spark.sql("SELECT redact_pii() AS a, generate_safe_steps()[0] AS b, "
                    "size(get_links('see www.x.com and https://y.io/z')) AS c, risk_verdict(80) AS d").first()
    assert row.a == "" and row.b == C.SAFE_STEPS["before_click"][0] and row.c == 2 and row.d == "High"


def test_windows_drop_late_rows(spark, tmp_path):
    import datetime as dt
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name, ids, days):
        start = dt.datetime(2024, 1, 1, 12)
        pq.write_table(pa.table({
            "event_id": pa.array(ids, pa.int64()),
            "ts": pa.array([start + dt.timedelta(days=d) for d in days], pa.timestamp("us")),
            "user_id": pa.array([7] * len(ids), pa.int64()),
            "event_type": ["view"] * len(ids), "value": [1.0] * len(ids),
            "props": ["{}"] * len(ids)}), str(tmp_path / "events.parquet" / name))
    (tmp_path / "events.parquet").mkdir()
    # batch 0: day 1 x10 and day 3; batch 1: day 5; batch 2: 5 rows for day 1.
    # Spark judges lateness against the previous batch's watermark, so by
    # batch 2 the day-1 window is closed and its late rows are dropped.
    write("events_1.parquet", list(range(10)) + [10], [0] * 10 + [2])
    time.sleep(1.1)                                                       # file order = arrival order
    write("events_2.parquet", [16], [4])
    time.sleep(1.1)
    write("events_3.parquet", list(range(11, 16)), [0] * 5)
    out = os.path.join(checkpoint_dir(spark), "test-late", uuid.uuid4().hex)
    windows = jobs.stream_verdict_windows(jobs.stream_reports(jobs.message_stream(spark, str(tmp_path), max_files=1)))
    res = jobs.run_windows(windows, os.path.join(out, "o"), os.path.join(out, "c"))
    day1 = res.filter("window_start = '2024-01-01 00:00:00'").groupBy().sum("n_messages").first()[0]
    assert day1 == 10          # the 5 rows behind the watermark were dropped
    assert res.groupBy().sum("n_messages").first()[0] == 12   # open windows are in the result


def test_bounded_windows_hold_every_accepted_message(spark):
    from baitline.plans import queries as Q
    accepted = Q.accepted(spark, SF).count()
    assert Q.stream_verdict_windows(spark, SF).groupBy().sum("n_messages").first()[0] == accepted
    assert Q.stream_user_sessions(spark, SF).groupBy().sum("n_messages").first()[0] == accepted


def test_packets_survive_any_text(spark, tmp_path):
    from baitline.sources.sinks import read_packets, write_packets
    rows = [(1, "High", "a\u001eb\nc"), (2, "Low", '"quoted" \\ \r'), (3, "High", "")]
    write_packets(spark.createDataFrame(rows, "msg_id bigint, verdict string, report_draft string"),
                  str(tmp_path / "p"))
    got = sorted((r.msg_id, r.verdict, r.packet) for r in read_packets(spark, str(tmp_path / "p")).collect())
    assert got == rows


def test_first_marker_in_manifest_order(spark):
    from baitline.sources.fixtures import manifest_fields, screenshot_manifest
    man = screenshot_manifest()
    df = spark.createDataFrame([(man[2]["marker"] + man[1]["marker"],), ("none",), (None,)], "image string")
    got = [r.id for r in df.select(manifest_fields(F.col("image"))["id"].alias("id")).collect()]
    assert got == [man[1]["id"], None, None]


def test_calls_without_an_answer_are_listed(spark):
    from baitline.operators.notes import note_inputs
    df = spark.createDataFrame(
        [(1, "m1", 1, 0, None, "timed out", None, None), (1, "m2", 2, 0, 500, "broken", None, None),
         (2, "m1", 1, 0, None, None, None, None), (2, "m2", 2, 0, 200, None, '{"executive_summary": "x"}', "r")],
        "msg_id long, model string, model_rank int, attempt int, http_code int, error string, content string, "
        "request_id string")
    got = {r.msg_id: r for r in note_inputs(df).collect()}
    assert got[1].note_failure == C.REASON_ROUTING + "m1 -> timed out | m2 -> 500: broken"
    assert got[1].note_model is None and got[2].note_model == "m2"


ANSWERS = "msg_id long, model string, model_rank int, attempt int, http_code int, error string, content string, " \
          "request_id string, response_model string, usage string"


def _answers(spark, contents):
    return spark.createDataFrame([(i, "m", 1, 0, 200, None, x, "r", None, None) for i, x in enumerate(contents)], ANSWERS)


def test_only_one_whole_object_is_an_answer(spark):
    from baitline.operators.notes import note_inputs
    good = ['{"a": 1}', '{"a": ", "}', ' {"a": 1}\n', 'so {"a": 1} is it', '```json {"a": 1} ```', '{}', None, '{"a": 1} x']
    bad = ['[{"a": 1}]', '{"a": 1}{"b": 2}', '{"a": 1', '[1]', 'x', '', '"{}"', '3']
    got = {r.msg_id: r.note_model for r in note_inputs(_answers(spark, good + bad)).collect()}
    assert [got[i] for i in range(len(good + bad))] == ["m"] * len(good) + [None] * len(bad)


def test_the_end_of_an_answer_cannot_be_forged(spark):
    from baitline.operators import notes as N
    df = _answers(spark, ['{"a": 1}', '{"a": 1}, "end of answer"', '{"a": 1}, 2, "end of answer"', '{"a": 1}]'])
    got = [r.x for r in df.select(N.parse_whole(F.col("content")).isNotNull().alias("x")).collect()]
    assert got == [True, False, False, False]


def test_answer_fields_keep_their_json_type(spark):
    from baitline.operators import notes as N
    text = ('{"e": ["{brace", "[1, 2]", {"signal": " s ", "severity": "HIGH"}, {"why_it_matters": "w"}, 7, "sixth"],'
            ' "listed": "[\\"a\\", \\"b\\"]", "many": ["a", " ", "b", "c", "d"], "number": 3, "none": null}')
    o = N.parse_object(F.col("content"))
    row = _answers(spark, [text]).select(
        N.normalize_evidence(N.field(o, "e", "variant"), F.lit("Low")).alias("e"),
        N.normalize_evidence(N.field(o, "listed", "variant"), F.lit("Low")).alias("no_list"),
        *[N.string_list(N.field(o, k, "variant")).alias(k) for k in ("listed", "many", "number", "none")]).first()
    assert [(e.signal, e.why_it_matters, e.severity) for e in row.e] == [
        ("{brace", C.NOTE_WHY_DEFAULT, "low"), ("[1, 2]", C.NOTE_WHY_DEFAULT, "low"),
        ("s", C.NOTE_WHY_DEFAULT, "high"), ("7", C.NOTE_WHY_DEFAULT, "low")]
    assert row.no_list == [] and row.listed == ['["a", "b"]'] and row.many == ["a", "b", "c"]
    assert row.number == [] and row.none == []


def test_routes_retries_and_repeated_records(spark):
    from baitline.operators.notes import browser_answers, note_inputs
    ok = '{"a": 1}'
    rows = [(1, "m1", 1, 0, 429, "busy", None, None, None, None), (1, "m1", 1, 1, 200, None, ok, "r", "own", "{}"),
            (2, "m1", 1, 0, 500, "down", None, None, None, None), (2, "m1", 1, 1, 200, None, ok, None, None, None),
            (3, "m1", 1, 0, 429, "busy", None, None, None, None), (3, "m2", 2, 0, 200, None, "x", None, None, None),
            *[(4, f"m{i}", i, 0, 500, "down", None, None, None, None) for i in range(5, 0, -1)],
            (5, "m1", 1, 0, 500, "quota 429", None, None, None, None), (5, "m1", 1, 1, 200, None, ok, None, None, None)]
    df = spark.createDataFrame(rows + rows, ANSWERS)   # every call recorded twice
    got = {r.msg_id: r for r in note_inputs(df).collect()}
    assert (got[1].note_model, got[1].note_usage, got[1].note_failure) == ("own", "{}", None)
    assert got[2].note_failure == C.REASON_ROUTING + "m1 -> 500: down"   # no second try without a 429
    assert got[3].note_failure == C.REASON_ROUTING + "m1 -> 429: busy | m2 -> invalid JSON object"
    assert got[4].note_failure == C.REASON_ROUTING + " | ".join(f"m{i} -> 500: down" for i in (1, 2, 3))
    called = {r.msg_id: r.b_model for r in browser_answers(df).collect()}
    assert called == {1: "m1", 2: "m1", 3: "m2", 4: None, 5: "m1"}
    assert got[5].note_model == "m1"                                     # 429 anywhere in the failure
    assert "collect_list" not in note_inputs(df)._jdf.queryExecution().toString()


def test_the_worklist_is_a_null_safe_anti_join(spark):
    from baitline.operators.notes import unanswered
    from baitline.sources.fixtures import situations
    ok = '{"a": 1}'
    messages = spark.createDataFrame([(1, "before_click"), (2, "before_click"), (3, "curious"), (None, "compromised"),
                                      (4, None), (5, "clicked_only")], "msg_id long, situation string")
    calls = spark.createDataFrame([(1, "m", 1, 0, 200, None, ok, None, None, None), (2, "m", 1, 0, 500, "x", None, None, None, None),
                                   (5, "m", 1, 0, 200, None, "[1]", None, None, None)], ANSWERS)
    left = unanswered(messages, calls, situations(spark))
    assert sorted((r.msg_id is None, r.msg_id) for r in left.collect()) == [(False, 2), (False, 5), (True, None)]
    answered_null = calls.unionAll(spark.createDataFrame([(None, "m", 1, 0, 200, None, ok, None, None, None)], ANSWERS))
    assert sorted(r.msg_id for r in unanswered(messages, answered_null, situations(spark)).collect()) == [2, 5]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
