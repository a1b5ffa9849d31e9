"""Set-based domain operators: the distinct-domain dimension (D0/D12) and the
join-back of reports to links (D13 join form).

Plan notes (100 TB):
- ``domain_dimension`` is a hash aggregate on ``domain``; the partial
  (map-side) aggregate collapses a hot domain to one row per task before the
  shuffle, so a domain carrying a third of all links costs one row per task.
- Reports are computed after the aggregate, once per distinct domain.
- ``attach_reports`` joins links to the dimension on ``domain``. No broadcast
  hint: AQE measures the dimension at runtime and broadcasts it only when it is
  under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a sort-merge
  join whose skewed (hot-domain) partitions AQE splits. The per-message regroup
  collects at most the links of one message.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D


def report_of(domain: str | Column) -> Column:
    """The report of one domain."""
    return D.inspect_domain(domain)


def domain_dimension(links: DataFrame) -> DataFrame:
    """``domain, report, n_links`` for every distinct domain of ``links``."""
    counted = links.groupBy("domain").agg(F.count(F.lit(1)).alias("n_links"))
    return counted.select("domain", report_of("domain").alias("report"), "n_links")


def attach_reports(links: DataFrame, dimension: DataFrame) -> DataFrame:
    """``msg_id, domain_reports`` with reports in link order (``pos``)."""
    joined = links.select("msg_id", "pos", "domain").join(
        dimension.select("domain", "report"), "domain", "inner")
    grouped = joined.groupBy("msg_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "report"))).alias("_r"))
    return grouped.select("msg_id", F.transform("_r", lambda x: x["report"]).alias("domain_reports"))
