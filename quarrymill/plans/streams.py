"""Queries that run as streams."""

from __future__ import annotations

from quarrymill.streaming.ingest import event_windows

QUERIES = {"stream_event_windows": event_windows}
SQL = {
    "stream_event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL
        HAVING max(date_trunc('hour', ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
}
