"""Change logs: state, steps, undo, versions and superseded work.

Logs have a unique running number `seq` and a time in microseconds `us`.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tintwell.functions.color import num
from tintwell.operators.scan import WIDTH, last_known, previous, running_sum, with_block

SETTING = ["project", "section", "key"]
STEP_LIMIT = 200
STEP_GAP_US = 1_000_000
# Palette settings whose commit makes an automatic palette rerun.
AUTO_KEYS = ["source", "inkCount", "autoIncludeBackground", "autoStyle", "autoVividness", "autoVariant"]


def state_asof(changes: DataFrame, us: int) -> DataFrame:
    """Value of every setting at a time: project, section, key, value."""
    return changes.where(F.col("us") <= us).groupBy(*SETTING).agg(F.max_by("value", F.struct("us", "seq")).alias("value"))


def states_at(changes: DataFrame, times: list[int]) -> DataFrame:
    """The same at several times at once: project, section, key, at, value.

    A change first counts at the earliest listed time that is not before it, so
    changes fold per (setting, time) and only those folded rows are carried on.
    """
    marks = F.array(*[F.lit(t).cast("bigint") for t in sorted(times)])
    slot = F.size(F.filter(marks, lambda t: t < F.col("us")))
    folded = changes.withColumn("_slot", slot).where(F.col("_slot") < len(times)).groupBy(*SETTING, "_slot").agg(F.max_by("value", F.struct("us", "seq")).alias("value"))
    nxt = F.lead("_slot").over(Window.partitionBy(*SETTING).orderBy("_slot"))  # one row per listed time at most
    spans = folded.withColumn("_until", F.coalesce(nxt - 1, F.lit(len(times) - 1)))
    held = spans.select(*SETTING, "value", F.explode(F.sequence("_slot", "_until")).alias("_slot"))
    return held.select(*SETTING, F.get(marks, F.col("_slot")).alias("at"), "value")


def drop_noops(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Leaves out unfinished edits that set the value a setting already has."""
    seen = previous(changes, SETTING, "seq", {"_before": "value"}, width)
    idle = ~F.col("commit") & F.col("_before").isNotNull() & (F.col("_before") == F.col("value"))
    return seen.where(~idle).drop("_before")


def commit_steps(changes: DataFrame, gap_us: int = STEP_GAP_US, width: int = WIDTH) -> DataFrame:
    """Commits grouped into steps: changes' columns plus `step` (1, 2, ... per project).

    A commit that follows the project's previous one within the gap joins its step.
    """
    commits = changes.where("commit")
    seen = previous(commits, ["project"], "seq", {"_last_us": "us"}, width)
    opens = F.col("_last_us").isNull() | (F.col("us") - F.col("_last_us") > gap_us)
    return running_sum(seen, ["project"], "seq", opens.cast("bigint"), "step", width).drop("_last_us")


def history(steps: DataFrame, limit: int | None = None, width: int = WIDTH) -> DataFrame:
    """Steps that changed something, all or the last `limit` of each project: project, step, first_seq, last_seq, changed."""
    seen = previous(steps, SETTING, "seq", {"_before": "value"}, width)
    per_setting = seen.groupBy("project", "step", "section", "key").agg(
        F.min_by("_before", "seq").alias("_before"), F.max_by("value", "seq").alias("_after"), F.min("seq").alias("_first"), F.max("seq").alias("_last")
    )
    moved = ~F.col("_before").eqNullSafe(F.col("_after"))
    real = per_setting.groupBy("project", "step").agg(
        F.min("_first").alias("first_seq"), F.max("_last").alias("last_seq"), F.sum(moved.cast("bigint")).alias("changed")
    )
    real = real.where(F.col("changed") > 0)
    if limit is None:
        return real
    totals = real.groupBy("project").agg(F.count("*").alias("_total"))
    numbered = running_sum(real, ["project"], "first_seq", F.lit(1).cast("bigint"), "_at", width)
    return numbered.join(totals, "project").where(F.col("_total") - F.col("_at") < limit).drop("_total", "_at")


class Stacks:
    """A project's value with its undo and redo stacks, of at most `limit` entries."""

    def __init__(self, value=None, undo=(), redo=(), limit: int | None = None):
        self.value, self.undo, self.redo = value, deque(undo, limit), deque(redo, limit)

    def act(self, action: str, new) -> None:
        """A new step clears redo, a quiet change only moves the starting point; a step to the same value is none."""
        now = self.value
        if action == "set":
            if new != now and not (new != new and now != now):
                self.undo.append(now)
                self.redo.clear()
                self.value = new
        elif action == "quiet":
            self.value = new
        elif action == "undo" and self.undo:
            self.redo.append(now)
            self.value = self.undo.pop()
        elif action == "redo" and self.redo:
            self.undo.append(now)
            self.value = self.redo.pop()


def replay(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Value after replaying every project's actions: project, value, undo (depth), redo (depth).

    `log`: project, seq, action (set, quiet, undo, redo), value. Undo is strictly ordered, so this is one ordered pass:
    rows are dealt by project, sorted within their partitions (which may spill), and each task folds its rows as they
    stream by. It holds one Arrow batch and the stacks of one project, however long that project's log is. A null project
    is one project, and actions of any other kind change nothing.
    """
    rows = log.select("project", "seq", "action", "value").repartition("project").sortWithinPartitions("project", "seq")
    kind = log.schema["project"].dataType
    schema = StructType([StructField("project", kind), StructField("value", DoubleType()), StructField("undo", IntegerType()), StructField("redo", IntegerType())])
    arrow = to_arrow_schema(schema)

    def ended(done: list) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 4
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        started, project, s, done = False, None, Stacks(limit=limit), []
        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in ("project", "action", "value")}
            for p, action, value in zip(column["project"], column["action"], column["value"]):
                if p != project or not started:
                    if started:
                        done.append((project, s.value, len(s.undo), len(s.redo)))
                    started, project, s = True, p, Stacks(limit=limit)
                s.act(action, value)
            if len(done) >= 4096:
                yield ended(done)
                done = []
        if started:
            yield ended([*done, (project, s.value, len(s.undo), len(s.redo))])

    return rows.withColumn("value", F.col("value").cast("double")).mapInArrow(run, schema)


def stage_of(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the stage a change reruns: the setting's own, else its section's; null for none.

    `registry`: section, key, stage, stage_given, section_stage (a small table).
    """
    table = registry.select("section", "key", F.when(F.col("stage_given"), F.col("stage")).otherwise(F.col("section_stage")).alias("stage"))
    return changes.join(table, ["section", "key"], "left")


def versions(runs: DataFrame, keys: list[str], state: str, width: int = WIDTH) -> DataFrame:
    """Adds `rerun` (the state differs from the previous run) and `version` (reruns so far)."""
    seen = previous(runs, keys, "seq", {"_before": state, "_seq": "seq"}, width)
    differs = F.col("_seq").isNull() | ~F.col("_before").eqNullSafe(F.col(state))
    return running_sum(seen.withColumn("rerun", differs), keys, "seq", differs.cast("bigint"), "version", width).drop("_before", "_seq")


def rerun_report(versioned: DataFrame, levels: list[str], cost: str) -> DataFrame:
    """Reruns and their total cost, with subtotals from the right: levels, reruns, total."""
    return versioned.where("rerun").rollup(*levels).agg(F.count("*").alias("reruns"), F.sum(cost).alias("total"))


def coalesce_frames(changes: DataFrame, width: str = "1 minute") -> DataFrame:
    """One run per project and frame, with the last value: project, frame, changes, last_seq, value."""
    frames = changes.groupBy("project", F.window("ts", width).alias("w"))
    out = frames.agg(F.count("*").alias("changes"), F.max(F.struct("us", "seq", "value")).alias("l"))
    return out.select("project", F.col("w.start").alias("frame"), "changes", F.col("l.seq").alias("last_seq"), F.col("l.value").alias("value"))


def accept_latest(requests: DataFrame, responses: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds `accepted`: the response answers the newest request its client had made by then.

    `requests`: client, request_id, seq. `responses`: client, request_id, seq.
    Both share one running number, so the newest request is carried forward over
    their union and compared; no response meets more than one request.
    """
    asked = requests.select("client", "seq", F.col("request_id").alias("_asked"), F.lit(None).cast("bigint").alias("request_id"))
    answered = responses.select("client", "seq", F.lit(None).cast("bigint").alias("_asked"), "request_id")
    both = last_known(asked.unionByName(answered), ["client"], "seq", F.col("_asked"), "_newest", width)
    out = both.where(F.col("_asked").isNull())
    return out.select("client", "seq", "request_id", F.coalesce(F.col("_newest") == F.col("request_id"), F.lit(False)).alias("accepted"))


def draft_final(results: DataFrame, keys: list[str]) -> DataFrame:
    """Best result of a key: a final supersedes drafts, later supersedes earlier: keys, quality, value."""
    rank = F.when(F.col("quality") == "final", 1).otherwise(0)
    best = results.groupBy(*keys).agg(F.max_by(F.struct("quality", "value"), F.struct(rank, F.col("seq"))).alias("_b"))
    return best.select(*keys, "_b.quality", "_b.value")


#: Rows of a run of samples. A cost decays by 0.8 each row, so of what came before a run 1e-49 is left at its end.
RUN = 512


def fast_rise_cost(samples: DataFrame, keys: list[str], order: str, value: str, width: int = WIDTH) -> DataFrame:
    """Adds `cost`: rises at once to a higher sample, falls by a fifth of the way to a lower one.

    Row j of a run maps the cost c before the run to max(a, b c + d). With f = 0.8^j and P the running sum of
    0.2 m / f, b is f, d is f P, and a is f (P + the running maximum of m / f - P), so a run is two windows. A run takes
    the end of the one before it, on which runs further back have no effect in double precision.
    """
    rows = running_sum(samples, keys, order, F.lit(1).cast("bigint"), "_n", width)
    rows = rows.withColumn("_run", F.floor((F.col("_n") - 1) / RUN)).withColumn("_f", F.pow(num(0.8), (F.col("_n") - 1) % RUN + 1))
    upto = Window.partitionBy(*keys, "_run").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.col(value).cast("double")
    rows = rows.withColumn("_p", F.sum(m * 0.2 / F.col("_f")).over(upto)).withColumn("_top", F.max(m / F.col("_f") - F.col("_p")).over(upto))
    a, d = F.col("_f") * (F.col("_p") + F.col("_top")), F.col("_f") * F.col("_p")
    ends = rows.groupBy(*keys, (F.col("_run") + 1).alias("_run")).agg(F.max_by(F.when(F.col("_run") == 0, a).otherwise(F.greatest(a, d)), "_n").alias("_in"))
    joined = rows.join(ends, [*keys, "_run"], "left")
    cost = F.when(F.col("_in").isNull(), a).otherwise(F.greatest(a, F.col("_f") * F.col("_in") + d))
    return joined.select(*samples.columns, cost.alias("cost"))


def triggers(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Palette commits that make an automatic palette rerun: changes' columns.

    `changes`: project, seq, section, key (text), text (the value), commit. The
    palette's source and background option are carried forward to each change.
    """
    palette = changes.where(F.col("section") == "palette")
    known = last_known(palette, ["project"], "seq", F.when(F.col("key") == "source", F.col("text")), "_source", width)
    known = last_known(known, ["project"], "seq", F.when(F.col("key") == "autoIncludeBackground", F.col("text")), "_bg", width)
    wanted = F.col("key").isin(AUTO_KEYS) | ((F.col("key") == "paper") & (F.coalesce(F.col("_bg"), F.lit("false")) != "true"))
    return known.where((F.col("_source") == "auto") & F.col("commit") & wanted).drop("_source", "_bg")


#: Keys whose change runs a colour scheme again; entering scheme mode counts once it is committed.
SCHEME_KEYS = ("schemeIncludeBackground", "scheme", "schemeBase")


def scheme_triggers(changes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Palette changes that make a colour scheme rerun, finished or not: changes' columns. Input as for `triggers`."""
    palette = changes.where(F.col("section") == "palette")
    known = last_known(palette, ["project"], "seq", F.when(F.col("key") == "source", F.col("text")), "_source", width)
    entered = (F.col("key") == "source") & F.col("commit")
    return known.where((F.col("_source") == "scheme") & (entered | F.col("key").isin(*SCHEME_KEYS))).drop("_source")


def image_triggers(changes: DataFrame, images: DataFrame, width: int = WIDTH) -> DataFrame:
    """New images that make an automatic palette rerun, because the project's palette is automatic by then: project, seq.

    `images`: project, seq (place in the project's log, unlike that of any change).
    """
    told = changes.where((F.col("section") == "palette") & (F.col("key") == "source")).select("project", "seq", "text", F.lit(False).alias("_new"))
    asked = images.select("project", "seq", F.lit(None).cast("string").alias("text"), F.lit(True).alias("_new"))
    known = last_known(told.unionByName(asked), ["project"], "seq", F.col("text"), "_source", width)
    return known.where(F.col("_new") & (F.col("_source") == "auto")).select("project", "seq")


def open_tasks(events: DataFrame) -> DataFrame:
    """Messages of the tasks still open, in task order: project, busy (null text never appears).

    `events`: project, task, seq, message (null closes the task).
    """
    last = events.groupBy("project", "task").agg(F.max_by(F.struct("message"), "seq").alias("m"))
    shown = last.where(F.col("m.message").isNotNull())
    packed = shown.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("task", F.col("m.message").alias("message")))).alias("t"))  # open tasks only
    return packed.select("project", F.array_join(F.transform("t", lambda t: t["message"]), " · ").alias("busy"))


def progress(tiles: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Adds the finished share of the export after each tile."""
    totals = tiles.groupBy(key).agg(F.count("*").alias("_total"))
    done = running_sum(tiles, [key], "seq", F.lit(1).cast("bigint"), "_done", width)
    return done.join(totals, key).withColumn("fraction", F.col("_done") / F.col("_total")).drop("_done", "_total")
