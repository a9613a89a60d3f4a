"""Streaming queries: the events table comes in parts, streams stop after each and go on from their checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.plans.tables import read
from dramaturg.streaming import evidence as V
from dramaturg.streaming import windows as W
from dramaturg.streaming.arrivals import Arrivals, by_time, ending

QUERIES, SQL = {}, {}
PARTS = 3
#: Days, high evidence and rest asked by each resistance; the table has little high evidence a character.
GATES = {"low": (0, 1, 1), "moderate": (2, 0, 4), "core": (4, 1, 6)}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumnRenamed("user_id", "character").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(rows, name, make, late_days: int = 0, files: int | None = None, **how):
    """The stream over the rows in parts, and at last a row by which all days of the table are over, ``late_days`` of delay included."""
    end = F.date_add(F.to_date(F.max("ts")), 1 + late_days).cast("timestamp")
    last = ending(rows, "ts", end, character=-1, event_id=-1, kind="end")
    return Arrivals(rows, by_time(rows, "ts", PARTS), PARTS, name, last, files).run(make, **how)


@query("""WITH e AS (SELECT event_id, user_id AS "character", ts, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, value,
  event_type = 'purchase' AND event_id % 4 = 0 AS upd FROM events),
m AS (SELECT * FROM e WHERE NOT upd AND value >= 100 AND value < 300)
SELECT event_id, "character", CAST(day + 9 AS INTEGER) AS expired_on FROM m
WHERE day + 9 <= (SELECT max(day) + 1 FROM e) AND NOT EXISTS (SELECT 1 FROM e u WHERE u.upd AND u."character" = m."character" AND u.ts > m.ts AND u.day <= m.day + 8)""")
def evidence_expiry_stream(spark, sf_dir):
    """Medium evidence that no update consumed in eight days, told by timers as the days pass."""
    update = (F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0)
    kind = F.when(update, "update").when((F.col("value") >= 100) & (F.col("value") < 300), "medium")
    rows = _events(spark, sf_dir).select("character", "event_id", "ts", kind.alias("kind")).filter("kind is not null")
    return _run(rows, "expiry", lambda arriving: V.expired(arriving, 8))


@query("""SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) - 1) // 12 AS batch FROM events""")
def scene_batches_stream(spark, sf_dir):
    """Batches of twelve over triggers of a bounded number of files; all parts are there, a day waits until it is over."""
    rows = _events(spark, sf_dir).select("character", "event_id", "ts")
    return _run(rows, "scenes", lambda arriving: V.scene_batches(arriving, 12, "12 days"), 12, files=2, restart=False, files_per_trigger=2)


def _gate_sql() -> str:
    fields = ["mood", "goal", "belief"]
    span = "(SELECT min(day) - 1 AS low, max(day) - min(day) + 2 AS n FROM e)"

    def upto(name: str, day: str) -> str:
        return f"p.{name}[{day} - p.low + 1]"

    def since(name: str, old: str) -> str:
        return f"({upto(name, 'p.day')} - {upto(name, old)})"

    start = "greatest(s.eaten, p.low)"
    recent = f"greatest({start}, p.day - 9)"
    high, medium = since("highs", start), since("mediums", recent)
    days = f"({since('high_days', start)} + {since('medium_days', recent)})"
    own = lambda what: "CASE p.field " + " ".join(f"WHEN '{f}' THEN s.{what}_{f}" for f in fields) + " END"
    gate = lambda i: "CASE p.resistance " + " ".join(f"WHEN '{r}' THEN {g[i]}" for r, g in GATES.items()) + " END"
    decided = f"""SELECT p.*, {own('value')} AS old_value, {own('at')} AS old_at, {high} AS high, {medium} AS medium, {days} AS episodes, s.eaten, {', '.join(f's.value_{f}, s.at_{f}' for f in fields)}
  FROM s JOIN p ON p."character" = s."character" AND p.rn = s.rn + 1"""
    decision = f"""CASE WHEN old_value IS NULL THEN 'no_field'
    WHEN NOT (CASE WHEN p.resistance = 'low' THEN high >= {GATES['low'][1]} OR medium >= 2 ELSE episodes >= {gate(0)} AND high >= {gate(1)} END) THEN 'threshold'
    WHEN day - old_at < {gate(2)} THEN 'cooldown' WHEN new_value = old_value THEN 'no_change' ELSE 'accepted' END"""
    moved = ", ".join(
        f"CASE WHEN decision = 'accepted' AND field = '{f}' THEN new_value ELSE value_{f} END AS value_{f}, CASE WHEN decision = 'accepted' AND field = '{f}' THEN day ELSE at_{f} END AS at_{f}" for f in fields
    )
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS "character", date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, event_type = 'signup' AS asks, value FROM events),
b AS {span},
g AS (SELECT DISTINCT e."character", low, unnest(range(low, low + n)) AS day FROM e, b),
c AS (SELECT g."character", g.low, g.day, count(*) FILTER (value >= 200) AS h, count(*) FILTER (value >= 60 AND value < 200) AS m FROM g LEFT JOIN e ON e."character" = g."character" AND e.day = g.day AND NOT e.asks GROUP BY ALL),
k AS (SELECT *, sum(h) OVER w AS hs, sum(m) OVER w AS ms, sum(CASE WHEN h > 0 THEN 1 ELSE 0 END) OVER w AS hd, sum(CASE WHEN m > 0 AND h = 0 THEN 1 ELSE 0 END) OVER w AS md FROM c WINDOW w AS (PARTITION BY "character" ORDER BY day)),
l AS (SELECT "character", low, list(hs ORDER BY day) AS highs, list(ms ORDER BY day) AS mediums, list(hd ORDER BY day) AS high_days, list(md ORDER BY day) AS medium_days FROM k GROUP BY 1, 2),
p AS (SELECT event_id, "character", day, CASE event_id % 3 WHEN 0 THEN 'mood' WHEN 1 THEN 'goal' ELSE 'belief' END AS field, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'core' END AS resistance,
  'v' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS new_value, row_number() OVER (PARTITION BY "character" ORDER BY day, event_id) AS rn, low, highs, mediums, high_days, medium_days FROM e JOIN l USING ("character") WHERE asks),
i AS (SELECT c_custkey AS "character", 'v' || CAST(c_custkey % 3 AS VARCHAR) AS v FROM customer),
s AS (SELECT DISTINCT e."character", CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS eaten, i.v AS value_mood, CAST(NULL AS BIGINT) AS at_mood, CASE WHEN e."character" % 4 <> 0 THEN i.v END AS value_goal, CAST(NULL AS BIGINT) AS at_goal,
    i.v AS value_belief, CAST(NULL AS BIGINT) AS at_belief, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS old_value, CAST(0 AS BIGINT) AS episodes, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium
  FROM e LEFT JOIN i USING ("character")
  UNION ALL
  SELECT "character", rn, CASE WHEN decision = 'accepted' THEN day ELSE eaten END AS eaten, {moved}, event_id, field, decision, old_value, CAST(episodes AS BIGINT), CAST(high AS BIGINT), CAST(medium AS BIGINT)
  FROM (SELECT *, {decision} AS decision FROM ({decided}) p))
SELECT event_id, "character", field, decision, old_value, CAST(episodes AS INTEGER) AS episodes, CAST(high AS INTEGER) AS high, CAST(medium AS INTEGER) AS medium FROM s WHERE event_id IS NOT NULL"""


@query(_gate_sql())
def gate_stream(spark, sf_dir):
    """Proposals decided by keyed state that begins with a table: fields, evidence by day, the last update of each field."""
    asks = F.col("event_type") == "signup"
    kind = F.when(asks, "proposal").when(F.col("value") >= 200, "high").when(F.col("value") >= 60, "medium")
    n = F.col("event_id") % 3
    rows = _events(spark, sf_dir).select(
        "character", "event_id", "ts", kind.alias("kind"),
        F.when(asks, F.when(n == 0, "mood").when(n == 1, "goal").otherwise("belief")).alias("field"),
        F.when(asks, F.when(n == 0, "low").when(n == 1, "moderate").otherwise("core")).alias("resistance"),
        F.when(asks, F.concat(F.lit("v"), F.floor("value") % 3)).alias("value"),
    ).filter("kind is not null")
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("character"), F.explode(F.array(*map(F.lit, ["mood", "goal", "belief"]))).alias("field"))
    fields = people.filter((F.col("field") != "goal") | (F.col("character") % 4 != 0)).withColumn("value", F.concat(F.lit("v"), F.col("character") % 3))
    return _run(rows, "gate", lambda arriving: V.gated(arriving, fields, GATES))


_PART = "least((CAST(floor(epoch(ts)) AS BIGINT) - low) // width, 2)"
_CUT = "b AS (SELECT low, greatest(1, CAST(ceil((high + 1 - low) / 3) AS BIGINT)) AS width FROM (SELECT CAST(floor(min(epoch(ts))) AS BIGINT) AS low, CAST(floor(max(epoch(ts))) AS BIGINT) AS high FROM events))"


@query(f"""WITH {_CUT}, e AS (SELECT *, least({_PART} + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 2) AS part FROM events, b),
marks AS (SELECT part, max(max(epoch_ms(ts))) OVER (ORDER BY part) - 86400000 AS mark FROM e GROUP BY part),
d AS (SELECT event_type, date_trunc('day', ts) AS start, part FROM e),
kept AS (SELECT d.* FROM d LEFT JOIN marks ON marks.part = d.part - 1 WHERE coalesce(epoch_ms(start) + 86400000 > mark, true))
SELECT event_type, start, start + INTERVAL 1 DAY AS "end", count(*) AS n FROM kept GROUP BY 1, 2 HAVING epoch_ms(start) + 86400000 <= (SELECT max(mark) FROM marks)""")
def late_rows_dropped(spark, sf_dir):
    """Daily counts where every seventh row comes a part late: dropped where its day is behind the watermark, else counted."""
    rows = _events(spark, sf_dir).select("event_type", "event_id", "ts")
    part = F.least(by_time(rows, "ts", PARTS) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(PARTS - 1))
    return Arrivals(rows, part, PARTS, "late").run(lambda arriving: W.counted(arriving, "event_type", "ts", "1 day", "1 day"))


@query("""WITH o AS (SELECT user_id AS "character", ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY "character" ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT "character", min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY "character", k""")
def scene_sessions(spark, sf_dir):
    """Scenes as sessions of a character's events; a scene that spans two parts is one."""
    rows = _events(spark, sf_dir).select("character", "ts")
    return _run(rows, "sessions", lambda arriving: W.sessions(arriving, "character", "ts", "12 hours", "1 hour"), 2).filter("character <> -1")


@query(f"""WITH {_CUT}, e AS (SELECT event_id, ts, {_PART} AS part, unnest([0, 1, 2]) AS again FROM events, b),
r AS (SELECT event_id, ts, CASE WHEN again = 2 AND event_id % 11 = 0 THEN 2 WHEN event_id % 13 = 0 THEN least(part + 1, 2) ELSE part END AS part FROM e WHERE again = 0 OR (again = 1 AND event_id % 5 = 0) OR (again = 2 AND event_id % 11 = 0)),
marks AS (SELECT part, max(max(epoch_ms(ts))) OVER (ORDER BY part) - 86400000 AS mark FROM r GROUP BY part)
SELECT DISTINCT event_id, ts FROM r LEFT JOIN marks ON marks.part = r.part - 1 WHERE coalesce(epoch_ms(ts) > mark, true)""")
def repeated_rows_dropped(spark, sf_dir):
    """Rows that come again, at once or in the last part, are taken once; those that first come behind the watermark not at all."""
    events = _events(spark, sf_dir).select("event_id", "ts")
    part = by_time(events, "ts", PARTS)
    rows = events.select("event_id", "ts", part.alias("part"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("again"))
    rows = rows.filter((F.col("again") == 0) | ((F.col("again") == 1) & (F.col("event_id") % 5 == 0)) | ((F.col("again") == 2) & (F.col("event_id") % 11 == 0)))
    late = F.when((F.col("again") == 2) & (F.col("event_id") % 11 == 0), PARTS - 1).when(F.col("event_id") % 13 == 0, F.least(F.col("part") + 1, F.lit(PARTS - 1))).otherwise(F.col("part"))
    out = Arrivals(rows.withColumn("part", late), F.col("part"), PARTS, "repeats").run(lambda arriving: W.deduplicated(arriving, "event_id", "ts", "1 day"))
    return out.select("event_id", "ts")
