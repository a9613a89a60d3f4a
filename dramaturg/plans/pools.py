"""Queries on pools of field updates and on nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import nested
from dramaturg.operators import pool as P
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pool(spark, sf_dir):
    """Even customers have snapshots (their orders in time), odd ones a log (their line items' orders) and every one an audit."""
    o = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    fields = F.create_map(
        F.lit("mood"), F.col("o_orderpriority"), F.lit("goal"), F.col("o_orderstatus"),
        F.lit("wealth"), F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 50000).cast("string")),
    )
    snapshots = o.filter(F.col("o_custkey") % 2 == 0).select(
        F.lit("even").alias("corpus"), F.col("o_custkey").alias("character"), F.col("o_orderdate").cast("string").alias("episode"), "o_orderdate", "o_orderkey",
        F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 3) % 4).alias("version"), fields.alias("fields"),
    )
    change = lambda value, merge, ids: F.struct(F.lit(None).cast("string").alias("old_value"), value.alias("new_value"), merge.alias("merge_type"), ids.alias("evidence_ids"))
    k = F.col("o_orderkey")
    changes = F.create_map(
        F.lit("mood"), change(F.when(k % 7 != 0, F.col("o_orderpriority")), F.when(k % 4 != 0, "merge"), F.array(k - 1, k - 2)),
        F.lit("belief"), change(F.when(k % 3 == 0, F.col("o_orderstatus")), F.lit("replacement"), F.when(k % 2 == 0, F.array(k * 1000))),
    )
    log = o.filter(F.col("o_custkey") % 2 == 1).select(
        F.lit("odd").alias("corpus"), F.col("o_custkey").alias("character"), F.col("o_orderdate").cast("string").alias("episode"), changes.alias("changes"),
        F.concat(F.lit("order "), k).alias("reasoning"), F.lit("p0").alias("from_version"), F.lit("p1").alias("to_version"),
    )
    c = F.col("c_custkey")
    part = lambda ids, why: F.struct(ids.alias("evidence_ids"), why.alias("reasoning"))
    parts = F.array(part(F.array(c, c + 1), F.when(c % 2 == 0, F.col("c_mktsegment"))), part(F.array(c + 1, c + 2), F.when(c % 4 < 2, F.lit("grew"))))
    audits = read(spark, sf_dir, "customer").select(
        F.when(c % 2 == 0, "even").otherwise("odd").alias("corpus"), c.alias("character"), F.lit("1998-12-31").alias("episode"), F.when(c % 5 != 0, F.lit("values")).alias("field"), F.lit("old").alias("old_value"),
        F.col("c_mktsegment").alias("new_value"), F.slice(parts, 1, (c % 3).cast("int")).alias("applied"), F.lit("audit").alias("reasoning"),
    )
    stratum = F.when(F.col("field") == "mood", "low").when(F.col("field").isin("goal", "wealth"), "moderate").otherwise("core")
    bucket = F.when(F.col("episode") < "1995-01-01", "early").otherwise("late")
    return P.pooled([P.from_snapshots(snapshots, ["o_orderdate", "o_orderkey"]), P.from_log(log), P.from_audits(audits)], stratum, bucket)


_FIELD = "SELECT 'even' AS corpus, character, episode, '{f}' AS field, 'unknown_diff' AS merge_type, {f}0 AS old_value, {f} AS new_value, [] AS evidence_ids, 'from snapshots ' || e0 || '/' || v0 || ' to ' || episode || '/' || version AS reasoning, 'snapshot_diff' AS source, v0 AS from_version, version AS to_version FROM l WHERE v0 <> version AND {f} IS NOT NULL AND {f} IS DISTINCT FROM {f}0"
_POOL = f"""s AS (SELECT o_custkey AS character, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS episode, o_orderkey, 'p' || (o_orderkey // 3 % 4) AS version, o_orderpriority AS mood, o_orderstatus AS goal,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) END AS wealth FROM orders WHERE o_custkey % 2 = 0),
l AS (SELECT *, lag(version) OVER w AS v0, lag(episode) OVER w AS e0, lag(mood) OVER w AS mood0, lag(goal) OVER w AS goal0, lag(wealth) OVER w AS wealth0 FROM s WINDOW w AS (PARTITION BY character ORDER BY episode, o_orderkey)),
g AS (SELECT o_custkey AS character, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS episode, o_orderkey AS k, o_orderpriority, o_orderstatus FROM orders WHERE o_custkey % 2 = 1),
u AS ({_FIELD.format(f='mood')} UNION ALL {_FIELD.format(f='goal')} UNION ALL {_FIELD.format(f='wealth')}
  UNION ALL SELECT 'odd', character, episode, 'mood', CASE WHEN k % 4 <> 0 THEN 'merge' ELSE 'unknown' END, NULL, o_orderpriority, [k - 1, k - 2], 'order ' || k, 'evolution_log', 'p0', 'p1' FROM g WHERE k % 7 <> 0
  UNION ALL SELECT 'odd', character, episode, 'belief', 'replacement', NULL, o_orderstatus, CASE WHEN k % 2 = 0 THEN [k * 1000] ELSE [] END, 'order ' || k, 'evolution_log', 'p0', 'p1' FROM g WHERE k % 3 = 0
  UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END, c_custkey, '1998-12-31', CASE WHEN c_custkey % 5 <> 0 THEN 'values' ELSE 'personality' END, 'core_audit', 'old', c_mktsegment,
    CASE c_custkey % 3 WHEN 1 THEN [c_custkey, c_custkey + 1] ELSE [c_custkey, c_custkey + 1, c_custkey + 2] END,
    CASE WHEN c_custkey % 3 = 2 AND c_custkey % 4 = 0 THEN c_mktsegment || ' | grew' WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 2 AND c_custkey % 4 < 2 THEN 'grew' ELSE 'audit' END, 'core_audit', NULL, NULL FROM customer WHERE c_custkey % 3 > 0),
p AS (SELECT substr(md5(source || '|' || corpus || '|' || character || '|' || episode || '|' || field || '|' || substr(new_value, 1, 80)), 1, 12) AS update_id, *,
  CASE WHEN source = 'core_audit' THEN 'core' WHEN field = 'mood' THEN 'low' WHEN field IN ('goal', 'wealth') THEN 'moderate' ELSE 'core' END AS stratum, CASE WHEN episode < '1995-01-01' THEN 'early' ELSE 'late' END AS bucket FROM u)"""


@query(f"WITH {_POOL} SELECT * FROM p")
def field_update_pool(spark, sf_dir):
    """Field rows of snapshots, logs and audits with old and new value, merge type and cited ids."""
    return _pool(spark, sf_dir)


@query(f"""WITH {_POOL}, c AS (SELECT update_id, unnest(evidence_ids) AS scene_id, generate_subscripts(evidence_ids, 1) AS at_place FROM p),
e AS (SELECT DISTINCT update_id, scene_id, at_place FROM c)
SELECT update_id, string_agg(scene_id || ':' || coalesce(p_name, '') || CASE WHEN p_name IS NULL THEN '!' ELSE '' END, ',' ORDER BY at_place, scene_id) AS told FROM e LEFT JOIN part ON p_partkey = scene_id GROUP BY update_id""")
def pool_evidence(spark, sf_dir):
    """Cited ids of the pool with what they say, parts standing for scenes; those that aren't there are marked.

    An update told more than once has all that was cited for it.
    """
    scenes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), F.col("p_name").alias("summary"), F.col("p_brand").alias("significance"))
    rows = P.with_evidence(_pool(spark, sf_dir).filter(F.size("evidence_ids") > 0).select("update_id", "evidence_ids"), scenes)
    told = F.array_join(F.transform("evidence", lambda e: F.concat(e["scene_id"].cast("string"), F.lit(":"), e["summary"], F.when(e["missing"], "!").otherwise(""))), ",")
    return rows.select("update_id", told.alias("told")).distinct()


@query("""SELECT p_partkey, 'I am ' || upper(p_name) AS name, CASE WHEN p_size % 3 > 0 THEN [upper(p_brand), NULL, 'X'] END AS tags, upper(p_type) AS deep, p_size AS n, 'key' AS key FROM part""")
def nested_strings(spark, sf_dir):
    """Every string of a tree of lists, maps and records changed; keys, numbers and nulls stay."""
    part = read(spark, sf_dir, "part")
    tree = F.struct(
        F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("n")).alias("identity"),
        F.when(F.col("p_size") % 3 > 0, F.array(F.col("p_brand"), F.lit(None).cast("string"), F.lit("x"))).alias("tags"),
        F.create_map(F.lit("key"), F.array(F.struct(F.col("p_type").alias("t"), F.array(F.col("p_size")).alias("ns")))).alias("notes"),
    )
    done = nested.with_strings(part.select("p_partkey", tree.alias("tree")), "tree", F.upper)
    t = F.col("tree")
    return done.select(
        "p_partkey", F.concat(F.lit("I am "), t["identity"]["name"]).alias("name"), t["tags"].alias("tags"), t["notes"]["key"][0]["t"].alias("deep"), t["identity"]["n"].alias("n"), F.map_keys(t["notes"])[0].alias("key")
    )
