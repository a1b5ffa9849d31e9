"""Analytics over report rows.

Per-case views (A1-A4, A8) are array expressions inside each report row, so
they run in the report's own stage. Cross-case views shuffle once:

- ``recent_cases`` (A5/A6) is ``row_number() <= 8`` per user; Spark plans it
  with a partial ``WindowGroupLimit`` before the shuffle, so even a user with a
  third of all messages sends at most 8 rows per map task.
- ``campaigns`` (A7) is a hash aggregate: keyed by (domain, user) first, for the
  exact count of users, then by domain, each with partial aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import redact as R
from ..functions import report as G
from ..functions.rows import positioned
from ..plans.investigate import report_struct
from ..sources.history import newest_cases
from .domains import report_of


def evidence_stats(rep: DataFrame) -> DataFrame:
    """A1 + A8 previews."""
    scores = F.transform("domain_reports", lambda r: r["risk_score"])
    return rep.select(
        "msg_id",
        F.size("links").alias("n_links"),
        F.size(F.filter("domain_reports", lambda r: r["verdict"] == "High")).alias("n_high_domains"),
        F.coalesce(F.array_max(scores), F.lit(0)).alias("max_domain_risk"),
        F.size("indicators").alias("n_hooks"),
        F.size("trace").alias("trace_depth"),
        G.route_label(F.col("ai_analysis")).alias("ai_route"),
        "confidence",
        F.array_join(F.slice(F.transform("score_trace", lambda t: t["label"]), 1, 4), " | "
                     ).alias("trace_preview"),
        F.array_join(F.slice("breakdown", 1, 3), " | ").alias("breakdown_preview"))


def popup_preview(rep: DataFrame) -> DataFrame:
    """A8, popup form: headline, summary, the first three contributors with their tone, next step."""
    def js_or(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
    pills = F.transform(F.slice("score_trace", 1, 3), lambda t: F.concat(
        F.lit("+"), t["impact"].cast("string"), F.lit(" "), t["label"], F.lit(" ["), G.risk_band(t["impact"]), F.lit("]")))
    return rep.select(
        "msg_id", F.concat("verdict", F.lit(" / "), F.col("risk_score").cast("string")).alias("headline"),
        js_or(F.col("ai_analysis.executive_summary"), F.get("breakdown", 0), F.lit("Review recommended.")).alias("summary"),
        F.array_join(pills, " | ").alias("pills"),
        js_or(F.get("safe_steps", 0), F.lit("Use official channels before interacting.")).alias("next_step"))


def _by_impact(a: Column, b: Column) -> Column:
    """Descending impact, then trace position (stable)."""
    return (F.when(a["impact"] > b["impact"], -1).when(a["impact"] < b["impact"], 1)
            .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))


def top_contributors(rep: DataFrame, k: int = 3) -> DataFrame:
    """A2: top-k positive score contributors per case (an in-row sort, no shuffle)."""
    indexed = F.transform("score_trace", lambda t, i: F.struct(
        i.alias("pos"), t["label"].alias("label"), t["impact"].alias("impact")))
    top = F.slice(F.array_sort(F.filter(indexed, lambda t: t["impact"] > 0), _by_impact), 1, k)
    return rep.select("msg_id", positioned(top, ["label", "impact"], "rank"))


def primary_evidence(reports: Column, indicators: Column) -> Column:
    """A3: highest-risk domain (first on ties), else first category, else default."""
    best = F.array_max(F.transform(reports, lambda r: r["risk_score"]))
    top = F.get(F.filter(reports, lambda r: r["risk_score"] == best), 0)["domain"]
    return F.coalesce(top, F.get(indicators, 0)["category"], F.lit("No major signal"))


def case_id(msg_id: Column) -> Column:
    """A4: an id that does not show the message's own, the same on every run."""
    return F.concat(F.lit("case-"), F.substring(F.md5(msg_id.cast("string")), 1, 12))


def stored_report(rep: DataFrame) -> Column:
    """The nested report as the history keeps it: links by domain only, no transcription."""
    stored, safe_links = G.sanitize_for_history(F.col("redacted_text"), F.col("links"))
    return (report_struct(rep).withField("redacted_text", stored).withField("links", safe_links)
            .withField("extracted_text", F.lit(None).cast("string")))


def case_files(rep: DataFrame) -> DataFrame:
    """A4 with its report: the rows of the history store. A reader of a few report fields reads
    those columns only (nested column pruning)."""
    return case_records(rep, stored_report(rep).alias("report"))


def case_records(rep: DataFrame, *more: Column) -> DataFrame:
    """A4: the stored case row (sanitised text, route, counts)."""
    stored, safe_links = G.sanitize_for_history(F.col("redacted_text"), F.col("links"))
    return rep.select(
        case_id(F.col("msg_id")).alias("case_id"), "msg_id", "user_id", "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "verdict", "risk_score", "confidence", "situation",
        G.route_label(F.col("ai_analysis")).alias("ai_route"),
        F.size("domain_reports").alias("domain_count"),
        F.size("indicators").alias("indicator_count"),
        R.text_preview(F.col("redacted_text")).alias("text_preview"),
        stored.alias("stored_text"), safe_links.alias("stored_links"), *more)


def recent_cases(cases: DataFrame, n: int = C.HISTORY_SIZE, *more: Column) -> DataFrame:
    """Newest ``n`` cases per user with list-row labels."""
    return newest_cases(cases, n).select(
        "user_id", "rank", "msg_id", "case_id",
        F.date_format("ts", "MMM d, hh:mm a").alias("time_label"),
        G.status_line(F.col("verdict"), F.col("risk_score")).alias("status"),
        "text_preview", G.situation_label(F.col("situation")).alias("situation_label"),
        "domain_count", "indicator_count", "ai_route", *more)


def _domain_mentions(rep: DataFrame) -> DataFrame:
    """A row per link: (msg_id, user_id, ts, domain, is_first of its message)."""
    return (rep.select("msg_id", "user_id", "ts",
                       F.transform("domain_reports", lambda r: r["domain"]).alias("domains"))
            .select("msg_id", "user_id", "ts", positioned(F.transform("domains", lambda d, i: F.struct(
                d.alias("domain"), (F.array_position(F.col("domains"), d) == i + 1).alias("is_first"))),
                ["domain", "is_first"])))


def _campaign_rows(counted: DataFrame) -> DataFrame:
    """Campaign rows from ``domain, n_links, n_messages, n_users, first_ts, last_ts``: risk and
    brands depend on the domain alone and are computed once for each."""
    reported = counted.withColumn("report", report_of("domain"))
    return reported.select(
        "domain", "n_links", "n_messages", "n_users", F.col("report.risk_score").alias("max_risk"),
        F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.array_join("report.detected_brands", ",").alias("brands"))


def campaigns(rep: DataFrame) -> DataFrame:
    """Repeated domains across cases (``msg_id`` is unique in ``rep``).

    Each row marks the first link of its message to the domain, so messages are
    a plain sum and users the only distinct count.
    """
    return _campaign_rows(_domain_mentions(rep).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.sum(F.col("is_first").cast("bigint")).alias("n_messages"),
        F.countDistinct("user_id").alias("n_users"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


# --- A7 day by day: mergeable partial campaigns ----------------------------------------

def campaign_days(rep: DataFrame) -> DataFrame:
    """One row per (domain, day, user): sums and bounds. All columns merge, so a day is computed once.

    The exact set of users is the rows themselves: narrow rows, at most as many as links. Most
    domains have few users, for whom a bitmap of 4 KB each would fill a task's memory.
    """
    return _domain_mentions(rep).withColumn("day", F.to_date("ts")).groupBy("domain", "day", "user_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.sum(F.col("is_first").cast("bigint")).alias("n_messages"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_days(days: DataFrame) -> DataFrame:
    """A7 from any days' partial campaigns: equals ``campaigns`` over their messages."""
    users = days.groupBy("domain", "user_id").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_messages").alias("n_messages"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return _campaign_rows(users.groupBy("domain").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_messages").alias("n_messages"),
        F.count("user_id").alias("n_users"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")))


def campaign_totals(days: DataFrame) -> DataFrame:
    """A7 with totals: per domain verdict, per day, and over all (GROUPING SETS).

    ``level`` names the set; users are counted once in each, because their rows meet in one
    row per user and set before they are counted.
    """
    domains = days.select("domain").distinct()
    verdicts = domains.select("domain", report_of("domain")["verdict"].alias("domain_verdict"))
    rows = days.join(verdicts, "domain")
    verdict, day = F.col("domain_verdict"), F.col("day")
    user = F.col("user_id")
    users = rows.groupingSets([[verdict, user], [day, user], [user]], verdict, day, user).agg(
        F.grouping("domain_verdict").alias("no_verdict"), F.grouping("day").alias("no_day"),
        F.sum("n_links").alias("n_links"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    level = (F.when(F.col("no_verdict") == 0, "verdict").when(F.col("no_day") == 0, "day").otherwise("all"))
    return (users.groupBy(level.alias("level"), "domain_verdict", F.date_format("day", "yyyy-MM-dd").alias("day"))
            .agg(F.sum("n_links").alias("n_links"),
                 F.count("user_id").alias("n_users"),
                 F.date_format(F.min("first_ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
                 F.date_format(F.max("last_ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen")))


def brand_campaigns(rep: DataFrame) -> DataFrame:
    """A7 by claimed brand in the text (Brand Impersonation evidence)."""
    brand_ind = F.get(F.filter("indicators", lambda i: i["category"] == C.BRAND), 0)["detail"]
    brands = F.split(F.replace(brand_ind, F.lit("Claimed source: "), F.lit("")), ", ")
    rows = rep.select("msg_id", "user_id", "risk_score",
                      positioned(F.coalesce(brands, F.array().cast("array<string>")), None,
                                 "pos", "brand"))
    # a message names a brand once, so its rows are its messages
    return rows.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.countDistinct("user_id").alias("n_users"),
        F.max("risk_score").alias("max_risk"),
        F.round(F.avg("risk_score"), 2).alias("avg_risk"))
