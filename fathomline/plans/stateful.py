"""Ordered action logs, merges and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workspace
from ..streaming import ordered
from .registry import register
from .tables import SQL_EVENTS, events, read


@register(
    "event_log_latest_wins",
    f"WITH {SQL_EVENTS} SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM ev GROUP BY 1, 2",
)
def event_log_latest_wins(spark, d):
    """The last decision on each issue: one aggregate, combined before its shuffle, instead of a sort of the log."""
    latest = events(spark, d).groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("m"))
    return latest.select("user_id", "event_type", "m.event_id", "m.value")


@register(
    "window_replace_merge",
    f"""WITH {SQL_EVENTS}, old AS (SELECT user_id, CAST(floor(sec / 3600) AS BIGINT) AS h, round(max(value), 6) AS v, bool_or(event_type = 'purchase') AS accepted FROM ev WHERE event_id % 4 <> 3 GROUP BY 1, 2), new AS (SELECT user_id, CAST(floor(sec / 3600) AS BIGINT) AS h, round(min(value), 6) AS v FROM ev WHERE event_id % 4 = 3 GROUP BY 1, 2)
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.h, n.h) AS h, CASE WHEN o.accepted THEN o.v WHEN n.v IS NOT NULL THEN n.v ELSE o.v END AS v, CASE WHEN o.accepted THEN 'preserved' WHEN o.v IS NULL THEN 'added' WHEN n.v IS NOT NULL THEN 'replaced' ELSE 'kept' END AS action FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.h = n.h""",
)
def window_replace_merge(spark, d):
    """Replacement picks for some places; accepted ones are preserved, others outside the replacement kept."""
    ev = events(spark, d).withColumn("h", F.floor(F.col("sec") / 3600).cast("long"))
    old = ev.filter("event_id % 4 <> 3").groupBy("user_id", "h").agg(F.round(F.max("value"), 6).alias("ov"), F.bool_or(F.col("event_type") == "purchase").alias("accepted"))
    new = ev.filter("event_id % 4 = 3").groupBy("user_id", "h").agg(F.round(F.min("value"), 6).alias("nv"))
    both = old.join(new, ["user_id", "h"], "full")
    kept = F.coalesce("accepted", F.lit(False))
    return both.select("user_id", "h", F.when(kept, F.col("ov")).otherwise(F.coalesce("nv", "ov")).alias("v"), F.when(kept, "preserved").when(F.col("ov").isNull(), "added").when(F.col("nv").isNotNull(), "replaced").otherwise("kept").alias("action"))


@register(
    "conversation_replay",
    """WITH s AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = 'user' THEN n ELSE -n END) AS BIGINT) AS balance, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM s GROUP BY 1""",
)
def conversation_replay(spark, d):
    """An action log folded to its state: here the state does not depend on the order, so one aggregate replays it."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(-F.col("n"))).cast("long").alias("balance"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


#: Errors set a user's level to nothing, other actions add to it up to a cap, in the order of their numbers.
SQL_FOLD = """WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type, value FROM events), f AS (SELECT user_id, i, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE least(value, 1000) END AS level FROM s WHERE i = 1
    UNION ALL SELECT s.user_id, s.i, CASE WHEN s.event_type = 'error' THEN 0.0::DOUBLE ELSE least(f.level + s.value, 1000) END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT user_id, max(i) AS steps, round(arg_max(level, i), 4) AS level FROM f GROUP BY 1"""


@register(
    "ordered_fold_replay",
    SQL_FOLD,
)
def ordered_fold_replay(spark, d):
    """A state that does depend on the order: errors reset it, other actions add to it up to a cap.

    No task holds a user's log: each piece of it is folded to what it does to any state, which is to set it, or to add something up to some cap;
    these few numbers a piece are then applied in order.
    """
    cap, none = F.lit(1000.0), F.lit(float("inf"))
    pieces = read(spark, d, "events").groupBy("user_id", F.expr("event_id div 4096").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("l"))
    state = lambda sets, add, most: F.struct(sets.alias("sets"), add.alias("add"), most.alias("most"))

    def follow(acc, e):
        most = F.least(acc["most"] + e["value"], cap)
        on = state(acc["sets"], F.when(acc["sets"], 0.0).otherwise(acc["add"] + e["value"]), most)
        return F.when(e["event_type"] == "error", state(F.lit(True), F.lit(0.0), F.lit(0.0))).otherwise(on)

    maps = pieces.select("user_id", "piece", F.size("l").alias("steps"), F.aggregate("l", state(F.lit(False), F.lit(0.0), none), follow).alias("m"))
    log = maps.groupBy("user_id").agg(F.sum("steps").cast("long").alias("steps"), F.sort_array(F.collect_list(F.struct("piece", "m"))).alias("l"))
    level = F.aggregate("l", F.lit(0.0), lambda x, p: F.when(p["m"]["sets"], p["m"]["most"]).otherwise(F.least(x + p["m"]["add"], p["m"]["most"])))
    return log.select("user_id", "steps", F.round(level, 4).alias("level"))


def _level(level, action):
    return 0.0 if action["event_type"] == "error" else min(level + action["value"], 1000.0)


@register("stream_replay", SQL_FOLD)
def stream_replay(spark, d):
    """The same log as a stream of five batches that overlap in time: actions come as a shuffle within them has left them, and are put in order before they count."""
    folder = workspace.new_folder(spark, "actions")
    log = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    last = log.agg(F.max("event_id")).first()[0] or 0
    # An action is up to a tenth of the log late.
    part = F.floor((F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(last // 10 + 1))) * 5 / F.lit(last + last // 10 + 2)).cast("int")
    held = workspace.held(log.withColumn("part", part), "actions")
    for k in range(5):
        held.filter(F.col("part") == k).drop("part").write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = ordered.replayed_stream(stream, "user_id", "event_id", "event_id", ["event_type", "value"], _level, 0.0, last // 4, None)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(ordered.RESULT).parquet(f"{folder}/out").filter("kind = 'state'")
    latest = states.groupBy("key").agg(F.max_by(F.struct("folded", "state"), F.struct("at", "folded")).alias("m"))
    return latest.select(F.col("key").cast("long").alias("user_id"), F.col("m.folded").alias("steps"), F.round(F.col("m.state").cast("double"), 4).alias("level"))
