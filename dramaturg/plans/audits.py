"""Queries on audits of core traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.operators import audit as A
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _audits(spark, sf_dir):
    """A customer's four traits are audited at its fifth order: one or two answers, right or wrong in one of ten ways."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("character"), F.col("o_orderkey").alias("scene_id"))
    facts = o.groupBy("character").agg(F.min("scene_id").alias("low"), F.max("scene_id").alias("high"), F.count(F.lit(1)).alias("n"))
    c = read(spark, sf_dir, "customer").join(facts, F.col("c_custkey") == F.col("character"))
    k = F.col("c_custkey")
    way = k % 11
    ids = F.when(way == 3, F.array(F.col("low"), -k)).when(way == 4, F.array(F.col("low"))).otherwise(F.array(F.col("high"), F.col("low")))
    new = (
        F.when(way == 5, " . ").when(way == 6, "a lover of Food").when(way == 7, "CALM").when(way == 8, F.repeat(F.lit("very "), 12)).when(way == 9, F.repeat(F.lit("x"), 81)).otherwise(F.concat(F.lit("careful with "), F.lower("c_mktsegment"), F.lit(".")))
    )
    answer = lambda d, status, replacement: F.struct(F.lit(d).alias("descriptor"), status.alias("status"), replacement.alias("replacement"), ids.alias("evidence_ids"))
    response = F.array(
        answer(" kind ", F.when(way == 0, "still_accurate").otherwise("outdated"), new), answer("calm", F.when(k % 2 == 0, "outdated").otherwise("still_accurate"), F.lit("restless"))
    )
    rows = c.select(
        F.lit("d").alias("dataset"), k.alias("character"), F.lit("personality").alias("field"), F.lit(5).alias("at"), F.array(F.lit("kind"), F.lit("and loves food"), F.lit("calm"), F.lower("c_mktsegment")).alias("descriptors"),
        response.alias("response"), F.when(way == 2, F.array(F.lit("food"), F.lit("kin"))).otherwise(F.array(F.lit("food"))).alias("protected"), F.when(way == 1, F.array(F.lit("Kind"))).alias("locked"), F.col("n").alias("new_high"),
    )
    return rows, o.withColumn("dataset", F.lit("d"))


_JUDGED = """f AS (SELECT o_custkey AS k, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, low, high, n, c_custkey % 11 AS way FROM customer JOIN f ON k = c_custkey),
g AS (SELECT *, way NOT IN (3, 4) AND low <> high AS grounded FROM c),
a AS (SELECT *, CASE WHEN way = 0 THEN 'kept' WHEN way = 1 THEN 'locked' WHEN way = 2 THEN 'protected' WHEN NOT grounded THEN 'ungrounded' WHEN way = 5 THEN 'empty' WHEN way = 6 THEN 'collides' WHEN way = 7 THEN 'duplicate'
  WHEN way = 9 THEN 'too_long' ELSE 'changed' END AS first FROM g),
j AS (SELECT k, 0 AS place, 'kind' AS descriptor, first AS decision, CASE WHEN first = 'changed' THEN CASE WHEN way = 8 THEN 'very very very very very very very very very very very very' ELSE 'careful with ' || seg END END AS replacement, seg, n FROM a
  UNION ALL SELECT k, 1, 'and loves food', 'kept', NULL, seg, n FROM a
  UNION ALL SELECT k, 2, 'calm', CASE WHEN k % 2 = 1 THEN 'kept' WHEN first = 'changed' THEN 'too_many' WHEN NOT grounded THEN 'ungrounded' ELSE 'changed' END, CASE WHEN k % 2 = 0 AND first <> 'changed' AND grounded THEN 'restless' END, seg, n FROM a
  UNION ALL SELECT k, 3, seg, 'kept', NULL, seg, n FROM a),
r AS (SELECT k, place, descriptor, CASE WHEN n < 4 THEN 'skipped' ELSE decision END AS decision, CASE WHEN n >= 4 THEN replacement END AS replacement FROM j)"""


@query(f'WITH {_JUDGED} SELECT k AS "character", CAST(place AS INT) AS place, descriptor, decision, replacement FROM r')
def core_audit_descriptors(spark, sf_dir):
    """What becomes of each descriptor of each audit; every reason to refuse occurs."""
    rows, archive = _audits(spark, sf_dir)
    return A.judged(rows, archive).select("character", "place", "descriptor", "decision", "replacement")


@query(f"""WITH {_JUDGED}, v AS (SELECT k, string_agg(coalesce(replacement, descriptor), ', ' ORDER BY place) AS new_value FROM r GROUP BY k HAVING bool_or(decision = 'changed')),
s AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ep, o_orderkey FROM orders),
b AS (SELECT s.*, CASE WHEN ep > 5 AND (o_orderkey % 4 = 0) THEN 1 ELSE 0 END AS apart FROM s), x AS (SELECT *, max(apart) OVER (PARTITION BY k ORDER BY ep) AS gone FROM b)
SELECT x.k AS "character", CAST(ep AS INT) AS ep, CASE WHEN ep >= 5 AND gone = 0 AND new_value IS NOT NULL THEN new_value WHEN apart = 1 THEN 'other' ELSE 'base' END AS audited FROM x LEFT JOIN v USING (k)""")
def core_audit_forward(spark, sf_dir):
    """Audited values in the snapshots from the audit on, as long as those had the audited value."""
    rows, archive = _audits(spark, sf_dir)
    from pyspark.sql.window import Window

    ep = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = read(spark, sf_dir, "orders").select(F.lit("d").alias("dataset"), F.col("o_custkey").alias("character"), F.lit("personality").alias("field"), ep.alias("ep"), "o_orderkey")
    s = s.withColumn("value", F.when((F.col("ep") > 5) & (F.col("o_orderkey") % 4 == 0), "other").otherwise("base"))
    return A.carried_on(s, A.audited_values(A.judged(rows, archive))).select("character", "ep", "audited")
