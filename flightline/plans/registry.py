"""The queries over the supplied tables, and their SQL."""

from __future__ import annotations

from flightline.plans import agent_queries, evaluation_queries, feature_queries, label_queries, model_queries, replay_queries, report_queries, series_queries
from flightline.plans.book import Query

BOOKS = (series_queries.BOOK, agent_queries.BOOK, evaluation_queries.BOOK, feature_queries.BOOK, label_queries.BOOK, report_queries.BOOK, replay_queries.BOOK, model_queries.BOOK)


def queries() -> dict[str, Query]:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
