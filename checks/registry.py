"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.feeds import FEED_SQL, FEEDS
from checks.ledger import JOB_SQL, JOBS, on_books
from checks.reports import REPORT_SQL, REPORTS
from platter.schema import Tables
from platter.sources.retail import retail_tables

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plan(retail_tables(spark, folder))


def all_queries() -> dict[str, Query]:
    reports = {name: _on_tables(plan) for name, (plan, _) in REPORTS.items()}
    jobs = {name: on_books(job) for name, (job, _) in (JOBS | FEEDS).items()}
    return reports | jobs


def all_sql() -> dict[str, str]:
    return REPORT_SQL | JOB_SQL | FEED_SQL
