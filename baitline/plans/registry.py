"""Registry of named queries and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as Q

SPARK_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "verdict_by_event_type": Q.verdict_by_event_type,
    "message_redaction": Q.message_redaction,
    "document_redaction": Q.document_redaction,
    "conversation_signals": Q.conversation_signals,
    "message_links": Q.message_links,
    "page_links": Q.page_links,
    "domain_dimension": Q.domain_dimension,
    "message_domain_reports": Q.message_domain_reports,
    "domain_join_back": Q.domain_join_back,
    "message_signals": Q.message_signals,
    "signal_hits_long": Q.signal_hits_long,
    "risk_scores": Q.risk_scores,
    "score_trace": Q.score_trace,
    "safe_plan": Q.safe_plan,
    "analyst_notes": Q.analyst_notes,
    "case_packets": Q.case_packets,
    "investigation_trace": Q.investigation_trace,
    "report_labels": Q.report_labels,
    "intake_quarantine": Q.intake_quarantine,
    "screenshot_texts": Q.screenshot_texts,
    "ocr_texts": Q.ocr_texts,
    "evidence_stats": Q.evidence_stats,
    "top_contributors": Q.top_contributors,
    "primary_evidence": Q.primary_evidence,
    "case_records": Q.case_records,
    "recent_cases": Q.recent_cases,
    "campaigns": Q.campaigns,
    "brand_campaigns": Q.brand_campaigns,
    "lite_triage": Q.lite_triage,
    "lite_reports": Q.lite_reports,
    "lite_agreement": Q.lite_agreement,
    "browser_overlay": Q.browser_overlay,
    "sql_tools": Q.sql_tools,
    "sql_tool_rows": Q.sql_tool_rows,
    "analyst_notes_live": Q.analyst_notes_live,
    "prompt_payloads": Q.prompt_payloads,
    "conversation_reports": Q.conversation_reports,
    "document_reports": Q.document_reports,
    "page_reports": Q.page_reports,
    "dashboard_steps": Q.dashboard_steps,
    "breakdown_topics": Q.breakdown_topics,
    "popup_previews": Q.popup_previews,
    "campaigns_by_day": Q.campaigns_by_day,
    "campaign_totals": Q.campaign_totals,
    "lite_agreement_totals": Q.lite_agreement_totals,
    "lite_domain_records": Q.lite_domain_records,
    "browser_payloads": Q.browser_payloads,
    "browser_reports": Q.browser_reports,
    "unanswered_messages": Q.unanswered_messages,
    "request_intake": Q.request_intake,
    "export_files": Q.export_files,
    "sample_matches": Q.sample_matches,
    "screenshot_fixtures": Q.screenshot_fixtures,
    "lexicon_hits": Q.lexicon_hits,
    "report_exports": Q.report_exports,
    "packet_files": Q.packet_files,
    "history_store": Q.history_store,
    "stream_reports": Q.stream_reports,
    "stream_verdict_windows": Q.stream_verdict_windows,
    "stream_sliding_windows": Q.stream_sliding_windows,
    "stream_user_sessions": Q.stream_user_sessions,
    "stream_history": Q.stream_history,
    "stream_dedup": Q.stream_dedup,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.verdict_by_event_type(spark, sf_dir)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(SPARK_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle_queries import oracle_queries
    return {k: v for k, v in oracle_queries().items() if k in SPARK_QUERIES}
