"""Change logs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tintwell.operators import history as J
from tintwell.plans.curve_queries import R
from tintwell.plans.registry import query
from tintwell.session import read_table
from tintwell.sources import bridge as B

#: Narrow blocks, so that the comparison crosses many block borders.
W = 512
DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
TIMES = [START + d * DAY for d in (3, 10, 17, 24)]


@query("j1_state_asof", B.ctes("changes") + f" SELECT project, section, key, arg_max(value, seq) AS value FROM changes WHERE us <= {TIMES[1]} GROUP BY ALL")
def j1_state_asof(spark, folder):
    return J.state_asof(B.changes(spark, folder), TIMES[1])


@query(
    "j1_states_at",
    B.ctes("changes") + f", t(at_) AS (VALUES {', '.join(f'({t}::BIGINT)' for t in TIMES)}) SELECT project, section, key, at_ AS at, arg_max(value, seq) AS value FROM changes JOIN t ON us <= at_ GROUP BY ALL",
)
def j1_states_at(spark, folder):
    return J.states_at(B.changes(spark, folder), TIMES)


# Values cut to tens, so that repeats happen.
COARSE = "coarse AS (SELECT project, ts, us, seq, section, CAST(key % 3 AS INTEGER) AS key, floor(value / 60) * 60 AS value, commit FROM changes)"


def coarse(spark, folder):
    return B.changes(spark, folder).withColumns({"key": F.col("key") % 3, "value": (F.floor(F.col("value") / 60) * 60).cast("double")})


@query(
    "j2_drop_noops",
    B.ctes("changes") + f", {COARSE}, l AS (SELECT *, lag(value) OVER (PARTITION BY project, section, key ORDER BY seq) AS before FROM coarse) SELECT project, seq, section, key, value FROM l WHERE commit OR before IS NULL OR before <> value",
)
def j2_drop_noops(spark, folder):
    return J.drop_noops(coarse(spark, folder), W).select("project", "seq", "section", "key", "value")


GAP = 6 * 3_600_000_000
STEPS = f"""com AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY project ORDER BY seq) <= {GAP} THEN 0 ELSE 1 END AS opens FROM coarse WHERE commit),
steps AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY project ORDER BY seq) AS BIGINT) AS step FROM com)"""


@query("j3_commit_steps", B.ctes("changes") + f", {COARSE}, {STEPS} SELECT project, seq, step FROM steps")
def j3_commit_steps(spark, folder):
    return J.commit_steps(coarse(spark, folder), GAP, W).select("project", "seq", "step")


@query(
    "j4_history",
    B.ctes("changes")
    + f""", {COARSE}, {STEPS}, pv AS (SELECT *, lag(value) OVER (PARTITION BY project, section, key ORDER BY seq) AS before FROM steps),
ps AS (SELECT project, step, section, key, arg_min(CASE WHEN before IS NULL THEN -1 ELSE before END, seq) AS b, arg_max(value, seq) AS a, min(seq) AS f, max(seq) AS l FROM pv GROUP BY ALL),
rl AS (SELECT project, step, min(f) AS first_seq, max(l) AS last_seq, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM ps GROUP BY project, step)
SELECT * FROM rl WHERE changed > 0 QUALIFY row_number() OVER (PARTITION BY project ORDER BY first_seq DESC) <= 200""",
)
def j4_history(spark, folder):
    return J.history(J.commit_steps(coarse(spark, folder), GAP, W), J.STEP_LIMIT, W)


ACTIONS = "log AS (SELECT project, seq, CASE WHEN key % 7 < 3 THEN 'set' WHEN key % 7 < 5 THEN 'undo' WHEN key % 7 = 5 THEN 'redo' ELSE 'quiet' END AS action, value FROM changes)"


def actions(spark, folder):
    k = F.col("key") % 7
    kind = F.when(k < 3, "set").when(k < 5, "undo").when(k == 5, "redo").otherwise("quiet")
    return B.changes(spark, folder).select("project", "seq", kind.alias("action"), "value")


@query(
    "j5_replay",
    B.ctes("changes").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {ACTIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS rn, count(*) OVER (PARTITION BY project) AS n FROM log),
rec AS (SELECT project, 0::BIGINT AS rn, NULL::DOUBLE AS v, []::DOUBLE[] AS u, []::DOUBLE[] AS r FROM (SELECT DISTINCT project FROM log) d
  UNION ALL SELECT q.project, q.rn,
    CASE WHEN action IN ('set', 'quiet') THEN value WHEN action = 'undo' AND len(u) > 0 THEN u[len(u)] WHEN action = 'redo' AND len(r) > 0 THEN r[len(r)] ELSE v END,
    CASE WHEN action = 'set' AND value IS DISTINCT FROM v THEN CASE WHEN len(u) >= 200 THEN list_append(u[2:], v) ELSE list_append(u, v) END WHEN action = 'undo' AND len(u) > 0 THEN u[1:len(u) - 1] WHEN action = 'redo' AND len(r) > 0 THEN list_append(u, v) ELSE u END,
    CASE WHEN action = 'set' AND value IS DISTINCT FROM v THEN []::DOUBLE[] WHEN action = 'undo' AND len(u) > 0 THEN list_append(r, v) WHEN action = 'redo' AND len(r) > 0 THEN r[1:len(r) - 1] ELSE r END
  FROM rec JOIN num q ON q.project = rec.project AND q.rn = rec.rn + 1)
SELECT rec.project, v AS value, CAST(len(u) AS INTEGER) AS undo, CAST(len(r) AS INTEGER) AS redo FROM rec JOIN (SELECT DISTINCT project, n FROM num) t ON t.project = rec.project AND t.n = rec.rn""",
)
def j5_replay(spark, folder):
    return J.replay(actions(spark, folder), limit=J.STEP_LIMIT)


REG_ROWS = [("click", k, "split" if k % 3 == 0 else None, k % 3 != 2, "halftone") for k in range(0, 100, 2)] + [("view", k, "mix", k % 2 == 0, None) for k in range(50)]
REG = "reg(section, key, stage, given, section_stage) AS (VALUES " + ", ".join(f"('{s}', {k}, {repr(t) if t else 'NULL'}, {str(g).lower()}, {repr(ss) if ss else 'NULL'})" for s, k, t, g, ss in REG_ROWS) + ")"


@query("j6_stage_of", B.ctes("changes") + f", {REG} SELECT seq, CASE WHEN given THEN stage ELSE section_stage END AS stage FROM changes LEFT JOIN reg USING (section, key)")
def j6_stage_of(spark, folder):
    reg = spark.createDataFrame(REG_ROWS, "section string, key int, stage string, stage_given boolean, section_stage string")
    return J.stage_of(B.changes(spark, folder), reg).select("seq", "stage")


VERSIONS = """ver AS (SELECT *, value IS DISTINCT FROM lag(value) OVER w OR lag(seq) OVER w IS NULL AS rerun FROM coarse WINDOW w AS (PARTITION BY project, section ORDER BY seq)),
vv AS (SELECT *, CAST(sum(CASE WHEN rerun THEN 1 ELSE 0 END) OVER (PARTITION BY project, section ORDER BY seq) AS BIGINT) AS version FROM ver)"""


@query("j7_versions", B.ctes("changes") + f", {COARSE}, {VERSIONS} SELECT seq, rerun, version FROM vv")
def j7_versions(spark, folder):
    return J.versions(coarse(spark, folder), ["project", "section"], "value", W).select("seq", "rerun", "version")


@query("j8_rerun_report", B.ctes("changes") + f", {COARSE}, {VERSIONS} SELECT project, section, count(*) AS reruns, CAST(sum(key) AS BIGINT) AS total FROM vv WHERE rerun GROUP BY ROLLUP (project, section)")
def j8_rerun_report(spark, folder):
    runs = J.versions(coarse(spark, folder), ["project", "section"], "value", W)
    return J.rerun_report(runs, ["project", "section"], "key")


@query(
    "j9_coalesce_frames",
    B.ctes("changes") + " SELECT project, CAST(us // 3600000000 AS BIGINT) AS frame, count(*) AS changes, max(seq) AS last_seq, arg_max(value, seq) AS value FROM changes GROUP BY 1, 2",
)
def j9_coalesce_frames(spark, folder):
    out = J.coalesce_frames(B.changes(spark, folder), "1 hour")
    return out.select("project", F.floor(B.micros("frame") / 3_600_000_000).alias("frame"), "changes", "last_seq", "value")


REQS = """req AS (SELECT project AS client, seq AS request_id, seq FROM changes WHERE section = 'click'), resp AS (SELECT project AS client, seq, us - key::BIGINT * 1800000000 AS asked_by FROM changes WHERE section = 'purchase'),
ans AS (SELECT s.client, s.seq, max(r.request_id) AS request_id FROM resp s JOIN changes c ON c.section = 'click' AND c.project = s.client AND c.us <= s.asked_by JOIN req r ON r.request_id = c.seq GROUP BY 1, 2)"""


def requests(spark, folder):
    c = B.changes(spark, folder)
    return c.where(F.col("section") == "click").select(F.col("project").alias("client"), F.col("seq").alias("request_id"), "seq", "us")


def responses(spark, folder):
    """Each purchase answers the last click made some hours before it."""
    from tintwell.operators.scan import last_known

    c = B.changes(spark, folder)
    probes = c.where(F.col("section") == "purchase").select(
        F.col("project").alias("client"), (F.col("us") - F.col("key").cast("bigint") * 1_800_000_000).alias("at"), F.col("seq").alias("resp"), F.lit(None).cast("bigint").alias("request_id")
    )
    asked = requests(spark, folder).select("client", F.col("us").alias("at"), F.lit(None).cast("bigint").alias("resp"), "request_id")
    known = last_known(asked.unionByName(probes), ["client"], "at", F.col("request_id"), "found", DAY)
    return known.where(F.col("resp").isNotNull() & F.col("found").isNotNull()).select("client", F.col("resp").alias("seq"), F.col("found").alias("request_id"))


@query(
    "j10_accept_latest",
    B.ctes("changes") + f", {REQS} SELECT a.client, a.seq, a.request_id, NOT EXISTS (SELECT 1 FROM req r WHERE r.client = a.client AND r.seq > a.request_id AND r.seq < a.seq) AS accepted FROM ans a",
)
def j10_accept_latest(spark, folder):
    return J.accept_latest(requests(spark, folder).drop("us"), responses(spark, folder), W)


@query(
    "j11_draft_final",
    B.ctes("changes")
    + """, r AS (SELECT project, key, seq, CASE WHEN section = 'purchase' THEN 'final' ELSE 'draft' END AS quality, value FROM changes)
SELECT project, key, quality, value FROM r QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY quality = 'final' DESC, seq DESC) = 1""",
)
def j11_draft_final(spark, folder):
    r = B.changes(spark, folder).select("project", "key", "seq", F.when(F.col("section") == "purchase", "final").otherwise("draft").alias("quality"), "value")
    return J.draft_final(r, ["project", "key"])


@query(
    "j12_fast_rise_cost",
    B.ctes("changes").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT section, seq, value, row_number() OVER (PARTITION BY section ORDER BY seq) AS rn FROM changes),
rec AS (SELECT section, seq, rn, value AS cost FROM n WHERE rn = 1 UNION ALL SELECT n.section, n.seq, n.rn, CASE WHEN n.value > r.cost THEN n.value ELSE r.cost * 0.8::DOUBLE + n.value * 0.2::DOUBLE END FROM rec r JOIN n ON n.section = r.section AND n.rn = r.rn + 1)
SELECT section, seq, round(cost, 5) AS cost FROM rec""",
)
def j12_fast_rise_cost(spark, folder):
    s = B.changes(spark, folder).select("section", "seq", "value")
    return J.fast_rise_cost(s, ["section"], "seq", "value", W).select("section", "seq", R("cost", "cost", 5))


_PKEYS = ["source", "inkCount", "paper", "autoStyle", "autoIncludeBackground", "scheme"]
PALETTE_LOG = f"""plog AS (SELECT project, seq, CASE WHEN section IN ('click', 'view', 'error') THEN 'palette' ELSE 'adjust' END AS section, ({_PKEYS!r})[key % 6 + 1] AS key, commit,
  CASE key % 6 WHEN 0 THEN CASE key % 18 WHEN 0 THEN 'auto' WHEN 6 THEN 'manual' ELSE 'scheme' END WHEN 4 THEN CASE WHEN key % 8 < 4 THEN 'true' ELSE 'false' END ELSE 'x' END AS text FROM changes)"""


@query(
    "j13_triggers",
    B.ctes("changes")
    + f""", {PALETTE_LOG}, st AS (SELECT *, last_value(CASE WHEN key = 'source' THEN text END IGNORE NULLS) OVER w AS src, last_value(CASE WHEN key = 'autoIncludeBackground' THEN text END IGNORE NULLS) OVER w AS bg FROM plog WHERE section = 'palette' WINDOW w AS (PARTITION BY project ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT project, seq, key FROM st WHERE src = 'auto' AND commit AND (key IN ('source', 'inkCount', 'autoStyle', 'autoIncludeBackground') OR (key = 'paper' AND coalesce(bg, 'false') <> 'true'))""",
)
def j13_triggers(spark, folder):
    return J.triggers(palette_log(spark, folder), W).select("project", "seq", "key")


def palette_log(spark, folder):
    c, k = B.changes(spark, folder), F.col("key")
    source = F.when(k % 18 == 0, "auto").when(k % 18 == 6, "manual").otherwise("scheme")
    text = F.when(k % 6 == 0, source).when(k % 6 == 4, F.when(k % 8 < 4, "true").otherwise("false")).otherwise("x")
    section = F.when(F.col("section").isin("click", "view", "error"), "palette").otherwise("adjust")
    return c.select("project", "seq", section.alias("section"), F.get(F.array(*[F.lit(n) for n in _PKEYS]), k % 6).alias("key"), "commit", text.alias("text"))


@query(
    "j13_scheme_triggers",
    B.ctes("changes")
    + f""", {PALETTE_LOG}, st AS (SELECT *, last_value(CASE WHEN key = 'source' THEN text END IGNORE NULLS) OVER (PARTITION BY project ORDER BY seq ROWS UNBOUNDED PRECEDING) AS src FROM plog WHERE section = 'palette')
SELECT project, seq, key FROM st WHERE src = 'scheme' AND (key = 'scheme' OR (key = 'source' AND commit))""",
)
def j13_scheme_triggers(spark, folder):
    return J.scheme_triggers(palette_log(spark, folder), W).select("project", "seq", "key")


@query(
    "j13_image_triggers",
    B.ctes("changes")
    + f""", {PALETTE_LOG}, im AS (SELECT project, seq FROM plog WHERE section = 'adjust'), told AS (SELECT project, seq, text FROM plog WHERE section = 'palette' AND key = 'source')
SELECT im.project, im.seq FROM im ASOF JOIN told ON told.project = im.project AND told.seq <= im.seq WHERE told.text = 'auto'""",
)
def j13_image_triggers(spark, folder):
    """The log's other changes stand for new images."""
    log = palette_log(spark, folder)
    return J.image_triggers(log, log.where(F.col("section") == "adjust").select("project", "seq"), W)


@query(
    "j14_open_tasks",
    B.ctes("changes")
    + """, l AS (SELECT project, CAST(key % 12 AS INTEGER) AS task, arg_max({'m': CASE WHEN section IN ('view', 'signup') THEN NULL ELSE section || ' ' || key END}, seq) AS s FROM changes GROUP BY 1, 2)
SELECT project, string_agg(s.m, ' · ' ORDER BY task) AS busy FROM l WHERE s.m IS NOT NULL GROUP BY project""",
)
def j14_open_tasks(spark, folder):
    c = B.changes(spark, folder)
    message = F.when(~F.col("section").isin("view", "signup"), F.concat_ws(" ", "section", F.col("key").cast("string")))
    return J.open_tasks(c.select("project", (F.col("key") % 12).alias("task"), "seq", message.alias("message")))


@query("j15_progress", "SELECT event_id AS seq, event_type AS export, round(row_number() OVER (PARTITION BY event_type ORDER BY event_id) / count(*) OVER (PARTITION BY event_type)::DOUBLE, 6) AS fraction FROM events")
def j15_progress(spark, folder):
    e = read_table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("export"))
    return J.progress(e, "export", W).select("seq", "export", R("fraction", "fraction"))
