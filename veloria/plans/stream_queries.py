"""Registered streams; each ends with what is landed and is compared with its batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import adapters as A
from ..sources.feature_view import base
from ..sources.files import shared_path
from ..streaming import streams
from .score_queries import SQL as SCORES
from .score_queries import feature_table


def _events(spark, d):
    return streams.timed(A.events_of(streams.landed(spark, f"{d}/events.parquet")))


def stream_index(spark, d):
    return streams.run(streams.sliding_index(_events(spark, d)), shared_path(spark, "index"))


def stream_counts(spark, d):
    return streams.run(streams.daily_counts(_events(spark, d)), shared_path(spark, "counts"))


def stream_dedup(spark, d):
    """Every event crawled twice, kept once."""
    twice = _events(spark, d).unionByName(_events(spark, d))
    return streams.run(streams.without_repeats(twice, ["event_id"]).select("event_id", "hero_name"), shared_path(spark, "dedup"))


def stream_upsert(spark, d):
    rows = A.events_of(streams.landed(spark, f"{d}/events.parquet", 1)).select("hero_name", "event_id", "event_type", "value")
    return streams.upsert_into(rows, shared_path(spark, "upsert"), ["hero_name"], "event_id")


def stream_late(spark, d):
    """Events of even number land first, the others after a restart; what is a day behind by then is dropped, and counted."""
    folder, out = shared_path(spark, "late-in"), shared_path(spark, "late")
    events = A.table(spark, d, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.parquet(f"{folder}/half={half}")
        rows = streams.timed(A.events_of(streams.landed(spark, folder)))
        kept = streams.run(streams.without_repeats(streams.counted(rows), ["event_id"]).select("event_id"), out)
    totals = streams.progress(spark, out).agg(F.sum("landed").alias("landed"), F.sum("dropped").alias("dropped"))
    return totals.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept"))))


def _scored_stream(spark, d):
    """Incoming items scored with the bounds that were fitted before, on facts known by then."""
    view = feature_table(spark, d)
    incoming = base(A.skins_of(streams.landed(spark, f"{d}/part.parquet")))
    known = view.select("skin_id", *[c for c in view.columns if c not in incoming.columns])
    return scoring.scorecard(incoming.join(known, "skin_id", "left"), scoring.fit(view))


def stream_scores(spark, d):
    return streams.run(_scored_stream(spark, d).select("skin_id", *scoring.WEIGHTS, "total_premium"), shared_path(spark, "scores"))


def stream_alerts(spark, d):
    return streams.run(scoring.risks(scoring.with_prices(_scored_stream(spark, d))), shared_path(spark, "alerts"))


def stream_quarantine(spark, d):
    rows = A.events_of(streams.landed(spark, f"{d}/events.parquet"))
    number = F.get_json_object("props", "$.k").try_cast("int")
    bad = streams.quarantined(rows, {"value": F.col("value") > 1, "k": number < 90})
    return streams.run(bad.select("event_id", F.array_join("failed", ",").alias("failed")), shared_path(spark, "quarantine"))


QUERIES = {f.__name__: f for f in (stream_index, stream_counts, stream_dedup, stream_late, stream_upsert, stream_scores, stream_alerts, stream_quarantine)}

_CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"
SQL = {
    "stream_index": f"WITH {A.HERO_EVENTS}, w AS (SELECT *, unnest(generate_series(0, 6)) AS k FROM hero_events), x AS (SELECT hero_name, date_trunc('day', ts) + INTERVAL 1 DAY * (k + 1) AS window_end, value FROM w) SELECT hero_name, window_end, round(avg(value), 6) AS value FROM x WHERE window_end {_CLOSED} GROUP BY 1, 2",
    "stream_counts": f"WITH x AS (SELECT event_type, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end FROM events) SELECT event_type, window_end, count(*) AS rows FROM x WHERE window_end {_CLOSED} GROUP BY 1, 2",
    "stream_dedup": f"WITH {A.HERO_EVENTS} SELECT event_id, hero_name FROM hero_events",
    "stream_late": "WITH l AS (SELECT count(*) AS dropped FROM events WHERE event_id % 2 = 1 AND ts <= (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 1 DAY) SELECT (SELECT count(*) FROM events) AS landed, dropped, (SELECT count(*) FROM events) - dropped AS kept FROM l",
    "stream_upsert": f"WITH {A.HERO_EVENTS} SELECT hero_name, event_id, event_type, value FROM hero_events QUALIFY row_number() OVER (PARTITION BY hero_name ORDER BY event_id DESC) = 1",
    "stream_scores": SCORES["scorecard"],
    "stream_alerts": SCORES["risk_alerts"],
    "stream_quarantine": "SELECT event_id, array_to_string(list_concat(CASE WHEN value > 1 THEN [] ELSE ['value'] END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 THEN [] ELSE ['k'] END), ',') AS failed FROM events WHERE NOT (value > 1 AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 90)",
}
