"""Streams over the event table; each must equal its batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell.operators import history as J
from tintwell.plans.curve_queries import R
from tintwell.plans.registry import ORACLES, query
from tintwell.sources import bridge as B
from tintwell.streaming import logs as ST
from tintwell.streaming.run import drain, stream_table


def changes(spark, folder):
    return B.change_columns(stream_table(spark, folder, "events"))


def latest(rows, keys: list[str], order: str = "batch"):
    """Newest update of every key."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("_r")).select("_r.*")


@query("stream_live_state", B.ctes("changes") + " SELECT project, section, key, arg_max(value, seq) AS value FROM changes GROUP BY ALL")
def stream_live_state(spark, folder):
    out = drain(ST.live_state(changes(spark, folder)), "update")
    return latest(out, ["project", "section", "key"]).drop("batch")


#: Everything the final watermark (the latest event less one hour) has passed is written.
_CLOSED = "(SELECT max(us) - 3600000000 FROM changes)"


@query(
    "stream_step_sessions",
    B.ctes("changes")
    + f""", com AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY project ORDER BY seq) < 7200000000 THEN 0 ELSE 1 END AS opens FROM changes WHERE commit), st AS (SELECT *, sum(opens) OVER (PARTITION BY project ORDER BY seq) AS step FROM com)
SELECT project, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS commits FROM st GROUP BY project, step HAVING max(us) + 7200000000 <= (SELECT max(us) - 3600000000 FROM changes WHERE commit)""",
)
def stream_step_sessions(spark, folder):
    return drain(ST.step_sessions(changes(spark, folder), "2 hours"))


@query(
    "stream_frames",
    B.ctes("changes")
    + f" SELECT project, CAST(us // 3600000000 AS BIGINT) AS frame, count(*) AS changes, max(seq) AS last_seq, arg_max(value, seq) AS value FROM changes GROUP BY 1, 2 HAVING (us // 3600000000 + 1) * 3600000000 <= {_CLOSED}".replace("HAVING (us // 3600000000 + 1)", "HAVING (min(us) // 3600000000 + 1)"),
)
def stream_frames(spark, folder):
    out = drain(ST.frames(changes(spark, folder), "1 hour"))
    return out.select("project", F.floor(B.micros("frame") / 3_600_000_000).alias("frame"), "changes", "last_seq", "value")


@query(
    "stream_accept_latest",
    B.ctes("changes")
    + """, m AS (SELECT project AS client, seq, section, CASE WHEN section = 'click' THEN seq ELSE seq - key % 40 END AS request_id FROM changes WHERE section IN ('click', 'purchase'))
SELECT client, seq, request_id, request_id = coalesce((SELECT max(r.seq) FROM m r WHERE r.client = m.client AND r.section = 'click' AND r.seq < m.seq), -1) AS accepted FROM m WHERE section = 'purchase'""",
)
def stream_accept_latest(spark, folder):
    c = changes(spark, folder).where(F.col("section").isin("click", "purchase"))
    is_request = F.col("section") == "click"
    m = c.select(
        F.col("project").alias("client"), "seq", "ts", F.when(is_request, "request").otherwise("response").alias("kind"), F.when(is_request, F.col("seq")).otherwise(F.col("seq") - F.col("key") % 40).alias("request_id")
    )
    return drain(ST.accept_latest(m))


@query("stream_fast_rise_cost", ORACLES["j12_fast_rise_cost"])
def stream_fast_rise_cost(spark, folder):
    out = drain(ST.fast_rise_cost(changes(spark, folder).select("section", "seq", "ts", "value"), "section"))
    return out.select("section", "seq", R("cost", "cost", 5))


@query("stream_replay", ORACLES["j5_replay"])
def stream_replay(spark, folder):
    c = changes(spark, folder)
    k = F.col("key") % 7
    kind = F.when(k < 3, "set").when(k < 5, "undo").when(k == 5, "redo").otherwise("quiet")
    out = drain(ST.replay(c.select("project", "seq", "ts", kind.alias("action"), "value"), limit=J.STEP_LIMIT), "update")
    return latest(out, ["project"], "seq").select("project", "value", "undo", "redo")


#: Requests that may supersede a response are at most three days older than it.
WAIT_US = 3 * 86_400_000_000


@query(
    "stream_accept_in_time",
    B.ctes("changes")
    + f""", q AS (SELECT project AS client, seq AS request_id, us FROM changes WHERE section = 'click'),
s AS (SELECT project AS client, seq, seq - key % 40 AS request_id, us FROM changes WHERE section = 'purchase'),
a AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM q WHERE q.client = s.client AND q.request_id > s.request_id AND q.us <= s.us AND q.us >= s.us - {WAIT_US}) AS accepted FROM s)
SELECT client, seq, request_id, accepted FROM a WHERE NOT accepted OR us < (SELECT least((SELECT max(us) FROM q), (SELECT max(us) FROM s))) - 3600000000""",
)
def stream_accept_in_time(spark, folder):
    """Accepted responses are written once the final watermark has passed them."""
    asked, answered = (changes(spark, folder).where(F.col("section") == kind) for kind in ("click", "purchase"))
    requests = asked.select(F.col("project").alias("client"), F.col("seq").alias("request_id"), "ts")
    responses = answered.select(F.col("project").alias("client"), "seq", (F.col("seq") - F.col("key") % 40).alias("request_id"), "ts")
    return drain(ST.accept_in_time(requests, responses, "3 days")).drop("ts")
