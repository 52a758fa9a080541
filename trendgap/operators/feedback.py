"""Status changes as an append-only log, and the state they add up to.

Plain tables have no UPDATE. A decision is a new row; the current state is the base
table with the latest decision per suggestion laid over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trendgap.operators.serving import APPROVED, REJECTED, VIDEO_READY
from trendgap.schemas import STATUS_EVENT


def _events(
    ids: DataFrame, status: str, at: Column, seq: Column, **values: Column
) -> DataFrame:
    given = {"ts": at, "seq": seq, "status": F.lit(status), **values}
    return ids.select(
        *[
            (F.col(f.name) if f.name == "suggestion_id" else given.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in STATUS_EVENT
        ]
    )


def approve(ids: DataFrame, at: Column, seq: Column) -> DataFrame:
    return _events(ids, APPROVED, at, seq)


def reject(ids: DataFrame, reason: Column, at: Column, seq: Column) -> DataFrame:
    return _events(ids, REJECTED, at, seq, reject_reason=reason)


def video_ready(ids: DataFrame, url: Column, at: Column, seq: Column) -> DataFrame:
    return _events(ids, VIDEO_READY, at, seq, video_url=url)


def latest(events: DataFrame) -> DataFrame:
    """Last status per suggestion, and the last link and reason that were given.

    Aggregates combine before the shuffle, so a suggestion with very many events
    reaches its final task as one row per map task.
    """
    when = F.struct("ts", "seq")

    def last(name: str) -> Column:
        value = F.col(name)
        moment = F.when(value.isNotNull(), when)
        return F.max_by(value, moment).alias(f"new_{name}")

    return events.groupBy("suggestion_id").agg(
        last("status"), last("video_url"), last("reject_reason")
    )


def current_state(suggestions: DataFrame, events: DataFrame) -> DataFrame:
    """Suggestions as they stand now. Events of unknown suggestions change nothing."""
    changed = ("status", "video_url", "reject_reason")
    joined = suggestions.join(latest(events), "suggestion_id", "left")
    return joined.select(
        *[
            F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c)
            for c in suggestions.columns
        ]
    )
