"""Reports over a file of one row group use many tasks, and the cheaper rules give what the plain ones give."""
import random
import re

import pytest
from pyspark.sql import functions as F

from baitline import constants as C
from baitline.functions import domains as D
from baitline.functions import links as L
from baitline.functions import redact as R
from baitline.functions import signals as T
from baitline.functions.regex import JS_SPACE, ascii_first, js_re, python_re
from baitline.functions.rule import lit, texts
from baitline.operators import lite as OL
from baitline.plans import queries as Q
from baitline.sources.messages import messages, view_columns
from baitline.streaming import jobs

EVENTS = "id AS event_id, timestamp_ntz '2024-01-01 00:00:00' AS ts, id % 7 AS user_id, 'view' AS event_type, 0D AS value, '' AS props"


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    spark.range(-40, 4000).coalesce(1).selectExpr(*EVENTS.split(", ")).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("query", [Q.verdict_by_event_type, Q.score_trace, Q.lite_agreement, Q.analyst_notes, Q.recent_cases, Q.prompt_payloads])
def test_reports_are_dealt_out(spark, one_group, query):
    plan = query(spark, one_group)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_one_row_group_becomes_many_tasks(spark, one_group):
    """Before, one task made all reports of a row group."""
    rows = Q.reports(spark, one_group).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 0.6 * sum(r["count"] for r in rows)


def test_streams_are_dealt_out(spark, one_group):
    assert "Repartition" in jobs.message_stream(spark, one_group, dealt=True)._jdf.queryExecution().analyzed().toString()


def test_the_view_is_the_shared_sql(spark, one_group):
    events = spark.read.parquet(f"{one_group}/events.parquet").unionByName(
        spark.range(1).selectExpr("cast(NULL AS bigint) AS event_id", *EVENTS.split(", ")[1:]))
    plain = events.selectExpr(*[f"{e} AS {n}" for n, e in view_columns()])
    from baitline.sources.messages import view
    assert view(events).exceptAll(plain).count() == plain.exceptAll(view(events)).count() == 0
    assert messages(spark, one_group).count() == messages(spark, one_group, dealt=True).count() == 4040


def test_methods_can_be_compiled(spark, one_group):
    """Before, the templates in the intake's filter made a method of 9,565 bytes; the JVM compiles up to 8,000."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(Q.message_links(spark, one_group)._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def _texts():
    rng = random.Random(5)
    ends = ["", " ", "\n", "\u0085", "　", "\r\n", " ", "é", "😀", "𝒂", "_", "9", ".", "​", "'", "-", "x"]
    parts = [*C.BRANDS, *(k for _, keywords, _ in C.SIGNAL_CATEGORIES for k in keywords or []), "shipping", "PayPal",
             "https://paypa1-x.xyz/é?q", "http://a＃b.top", "www.ex℀mple.com", "://", "$", "Confirm"]
    return [None, ""] + ["".join(rng.choice(ends) + rng.choice(parts) + rng.choice(ends) for _ in range(rng.randrange(1, 6))) for _ in range(600)]


def test_cheaper_rules_equal_plain_ones(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i int, t string").withColumn("low", F.lower("t"))
    edges = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    plain = {}
    for name, (_, words, _) in zip(T.HIT_COLUMNS, C.SIGNAL_CATEGORIES):
        word = "contains(low, b)" if words else f"low RLIKE concat({lit(edges[0])}, b, {lit(edges[1])})"
        plain[name] = F.expr(f"filter({texts(words or C.BRANDS)}, b -> {word})")
    hits = df.select("t", *[(c.eqNullSafe(plain[n])).alias(n) for n, c in T.signal_hit_columns("low").items()],
                     *[F.size(plain[n]).alias(f"n_{n}") for n in plain])
    for n in plain:
        assert hits.where(~F.col(n)).collect() == [] and hits.where(F.col(f"n_{n}") > 0).count() > 20, n
    url = F.regexp_extract_all("t", F.lit(js_re(C.LITE_URL_PATTERN)), 0)
    strip = F.regexp_replace("t", f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")
    lite = df.withColumn("lite_text", F.col("t")).select(
        R.strip_js(F.col("t")).eqNullSafe(strip).alias("strip"),
        F.transform(L.lite_links(F.col("t")), lambda l: l["original"]).eqNullSafe(url).alias("urls"),
        L.find_urls("t").eqNullSafe(F.regexp_extract_all("t", F.lit(python_re(C.URL_PATTERN)), 1)).alias("found"),
        *[OL._says(p).eqNullSafe(F.col("low").rlike(p)).alias(f"says{i}")
          for i, p in enumerate([C.LITE_PAYMENT_PATTERN, C.LITE_DATA_PATTERN, C.LITE_URGENCY_PATTERN])])
    for n in lite.columns:
        assert lite.where(~F.col(n)).count() == 0, n
    assert ascii_first(python_re(C.URL_PATTERN)) != python_re(C.URL_PATTERN)


def test_top_level_domains(spark):
    cases = ["a.xyz", "xyz", ".xyz", "a.xyz.", "a.b.live", "alive", "a.live.com", "", "x.TOP", "é.cc", "a.xyz.today"]
    for d, r in spark.createDataFrame([(d,) for d in cases], "d string").select("d", D.inspect_domain("d")["indicators"]).collect():
        ends = [C.TLD_TEXT + t for t in C.SUSPICIOUS_TLDS if d.lower().endswith(t)]
        assert [i for i in r if i.startswith(C.TLD_TEXT)] == ends, d
