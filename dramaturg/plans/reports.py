"""Queries on raters, judges, quotas, draws and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.operators import reports as R
from dramaturg.plans.tables import EVIDENCE_SQL, evidence, read, scores

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT l_returnflag AS method, l_linestatus AS split, CASE WHEN l_linestatus = 'O' THEN 'judge' || l_linenumber % 3 ELSE 'judge' || (1 + l_linenumber % 2) END AS judge_model, l_quantity AS score FROM lineitem),
g AS (SELECT method, split, judge_model, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1, 2, 3)
SELECT *, judge_model = coalesce(max(CASE WHEN judge_model = 'judge0' THEN judge_model END) OVER (PARTITION BY method, split), min(judge_model) OVER (PARTITION BY method, split)) AS "primary" FROM g""")
def multi_judge_rollup(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("split"), F.col("l_quantity").alias("score"),
        F.concat(F.lit("judge"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") % 3).otherwise(1 + F.col("l_linenumber") % 2).cast("string")).alias("judge_model"),
    )
    return R.by_judge(s, ["method", "split"], "judge_model", "score", "judge0")


_LABEL = "CASE WHEN l_quantity >= 35 THEN 'supported' WHEN l_quantity >= 15 THEN 'partial' ELSE 'unsupported' END"


@query(f"""WITH s AS (SELECT 'R' || (1 + l_linenumber % 3) AS rater, l_quantity / 10 AS score, {_LABEL} AS label FROM lineitem)
SELECT rater, round(avg(score), 4) AS mean_score, round(var_pop(score), 4) AS var_score, round(stddev_pop(score), 4) AS std_score, round(avg(CASE WHEN label = 'supported' THEN 100.0 ELSE 0 END), 1) AS pct_supported,
  round(avg(CASE WHEN label = 'partial' THEN 100.0 ELSE 0 END), 1) AS pct_partial, round(avg(CASE WHEN label = 'unsupported' THEN 100.0 ELSE 0 END), 1) AS pct_unsupported FROM s GROUP BY 1""")
def rater_statistics(spark, sf_dir):
    q = F.col("l_quantity")
    label = F.when(q >= 35, "supported").when(q >= 15, "partial").otherwise("unsupported")
    rated = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("R"), (1 + F.col("l_linenumber") % 3).cast("string")).alias("rater"), (q / 10).alias("score"), label.alias("label"))
    return R.rater_stats(rated, "rater", "score", "label", ["supported", "partial", "unsupported"])


@query("""WITH a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS b, CASE WHEN o_totalprice > 200000 THEN 'x' END AS c FROM orders),
f AS (SELECT *, CASE WHEN a = 'none' THEN 0 ELSE 1 END + CASE WHEN b = '' THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END AS filled FROM a)
SELECT o_custkey, o_orderkey, CAST(filled AS INT) AS filled FROM f WHERE filled > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY filled DESC, o_orderkey) = 1""")
def most_complete_record(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "none").otherwise(F.col("o_orderstatus")).alias("a"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("b"), F.when(F.col("o_totalprice") > 200000, "x").alias("c"),
    )
    return R.most_complete(o, "o_custkey", "o_orderkey", ["a", "b", "c"]).select("o_custkey", "o_orderkey", "filled")


@query("""WITH m AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END, p_brand) AS place FROM m)
SELECT p_brand, place, count(*) AS parts FROM part JOIN r USING (p_brand) GROUP BY 1, 2""")
def method_order(spark, sf_dir):
    return R.in_method_order(read(spark, sf_dir, "part"), "p_brand", ["Brand#3", "Brand#1"]).groupBy("p_brand", F.col("place").cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("parts"))


_METHODS = "SELECT n_name AS method, CASE WHEN n_nationkey % 3 = 0 THEN 'extended' ELSE 'full' END AS kind FROM nation"
_QUOTA = f"""m AS ({_METHODS}), b AS (SELECT *, CASE kind WHEN 'full' THEN 8 ELSE 4 END AS base, row_number() OVER (PARTITION BY kind ORDER BY method) - 1 AS turn FROM m),
z AS (SELECT greatest(200 - sum(base), 0) AS spare, count(*) FILTER (kind = 'full') AS n FROM b),
p AS (SELECT method, kind, CAST(base + CASE WHEN kind = 'full' THEN spare // n + CASE WHEN turn < spare % n THEN 1 ELSE 0 END ELSE 0 END AS INT) AS quota FROM b, z)"""


def _quotas(spark, sf_dir):
    m = read(spark, sf_dir, "nation").select(F.col("n_name").alias("method"), F.when(F.col("n_nationkey") % 3 == 0, "extended").otherwise("full").alias("kind"))
    return R.quota_plan(m, "kind", "method", 200)


@query(f"WITH {_QUOTA} SELECT method, kind, quota FROM p")
def quota_plan(spark, sf_dir):
    return _quotas(spark, sf_dir)


@query(f"""WITH {_QUOTA}, c AS (SELECT n_name AS method, c_mktsegment AS stratum, c_custkey % 100 AS item FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY method, item ORDER BY md5(CAST(item AS VARCHAR)), stratum) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY method, stratum ORDER BY md5(CAST(item AS VARCHAR)), item) AS turn FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY turn, stratum) AS place FROM t JOIN p USING (method)),
r AS (SELECT *, place > quota AS filler, row_number() OVER (PARTITION BY place > quota ORDER BY place - quota, method) AS f FROM o)
SELECT method, stratum, item, CAST(place AS INT) AS place, filler FROM r WHERE NOT filler OR f <= 200 - (SELECT count(*) FROM o WHERE place <= quota)""")
def quota_sample(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("n_name").alias("method"), F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 100).alias("item"))
    return R.quota_sample(rows, _quotas(spark, sf_dir), "method", "stratum", "item", 200).select("method", "stratum", "item", "place", "filler")


@query()
def weighted_draws(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.sqrt("n"))
    return R.drawn_with_replacement(sizes, "source", "n", "w", 1003, 50, 7)


@query(f"""WITH {EVIDENCE_SQL} SELECT event_id, (row_number() OVER (PARTITION BY "character" ORDER BY ep, event_id) - 1) // 12 AS batch FROM ev""")
def scene_batches(spark, sf_dir):
    return R.batches(evidence(spark, sf_dir), "character", ["ep", "event_id"], 12).select("event_id", "batch")


@query("""SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS scene_text FROM conversations GROUP BY conv_id""")
def scene_from_fullest_sample(spark, sf_dir):
    from dramaturg.operators.dialogue import cumulative_context

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("string").alias("text"))
    samples = cumulative_context(turns, "conv_id", "turn", "role", "text")
    return R.fullest_of_scene(samples, "conv_id", "turn", "context", F.concat("role", F.lit(": "), "text"))


@query(f"""WITH {EVIDENCE_SQL} SELECT "character", list(ep ORDER BY first, ep) AS episodes FROM (SELECT "character", ep, min(event_id) AS first FROM ev GROUP BY 1, 2) GROUP BY 1""")
def episodes_first_seen(spark, sf_dir):
    """Distinct episodes of a character in the order in which its events first name them."""
    seen = evidence(spark, sf_dir).groupBy("character", "ep").agg(F.min("event_id").alias("first"))
    return seen.groupBy("character").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "ep"))), lambda x: x.ep).alias("episodes"))


@query(f"""WITH {EVIDENCE_SQL} SELECT "character", event_type, count(*) AS n FROM ev WHERE significance <> 'high' GROUP BY 1, 2 ORDER BY n DESC, "character", event_type LIMIT 25""")
def decay_counters(spark, sf_dir):
    """The 25 pairs of character and partner with most decays: the report's own limit."""
    low = evidence(spark, sf_dir).filter("significance <> 'high'")
    return low.groupBy("character", "event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "character", "event_type").limit(25)


@query("""WITH p AS (SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)), done AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT doc_id, source, quality FROM p WHERE doc_id NOT IN (SELECT doc_id FROM done)""")
def predictions_with_references(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id")
    return both.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '?') AS stratum FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stratum_lookup(spark, sf_dir):
    strata = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("stratum"))
    return read(spark, sf_dir, "documents").select("doc_id").join(strata, "doc_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit("?")))


@query("""WITH s AS (SELECT conv_id, bool_or(role = 'assistant') AS speaks, bool_or(text LIKE '%assistant:%') AS named FROM conversations GROUP BY conv_id) SELECT conv_id, named FROM s WHERE speaks""")
def scenes_of_character(spark, sf_dir):
    """Scenes in which a character speaks, and whether a text names it as a speaker."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("speaks"), F.bool_or(F.col("text").contains("assistant:")).alias("named"))
    return c.filter("speaks").select("conv_id", "named")


@query("""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> ''""")
def role_training_rows(spark, sf_dir):
    return read(spark, sf_dir, "conversations").filter((F.col("role") == "assistant") & (F.trim("text") != "")).select("conv_id", "turn")


@query("""SELECT l_orderkey, l_linenumber, l_discount FROM lineitem ORDER BY l_discount, l_orderkey, l_linenumber LIMIT 10""")
def least_losses(spark, sf_dir):
    """The ten checkpoints of least loss (the operator's own limit)."""
    return read(spark, sf_dir, "lineitem").orderBy("l_discount", "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber", "l_discount")


@query("""SELECT 'log' AS origin, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS weight, NULL AS note FROM orders UNION ALL SELECT 'audit', c_custkey, NULL, c_mktsegment FROM customer""")
def update_pool(spark, sf_dir):
    """Logged updates and audits, of different columns, as one pool."""
    log = read(spark, sf_dir, "orders").select(F.lit("log").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("weight"))
    audit = read(spark, sf_dir, "customer").select(F.lit("audit").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("note"))
    return log.unionByName(audit, allowMissingColumns=True)


@query("""SELECT o_custkey, list(o_orderpriority ORDER BY first) AS kinds FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1""")
def ordered_unique(spark, sf_dir):
    told = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("all"))
    return told.select("o_custkey", F.array_distinct(F.col("all.o_orderpriority")).alias("kinds"))


@query(f"""WITH {EVIDENCE_SQL}, u AS (SELECT "character", ep AS version_ep, event_id AS version, list_transform(range(0, 3), lambda i: event_id - 2 * i) AS cited FROM ev WHERE event_type = 'signup'),
c AS (SELECT unnest(cited) AS event_id, "character", version_ep, version FROM u), f AS (SELECT c.event_id, arg_min(c.version, (c.version_ep, c.version)) AS consumed_by, min(c.version_ep) AS consumed_at FROM c JOIN ev USING (event_id) GROUP BY 1)
SELECT event_id, consumed_by, consumed_at FROM ev LEFT JOIN f USING (event_id)""")
def evidence_consumption(spark, sf_dir):
    """Cited evidence is consumed by the first version that cites it; the rest stays active (null)."""
    ev = evidence(spark, sf_dir)
    cited = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("event_id") - 2 * i))
    used = ev.filter("event_type = 'signup'").select(F.col("ep").alias("_ep"), F.col("event_id").alias("_version"), cited.alias("_id"))
    first = used.groupBy(F.col("_id").alias("event_id")).agg(F.min(F.struct("_ep", "_version")).alias("_f"))
    return ev.select("event_id").join(first, "event_id", "left").select("event_id", F.col("_f._version").alias("consumed_by"), F.col("_f._ep").alias("consumed_at"))


@query(f"""WITH {EVIDENCE_SQL} SELECT a.event_id, count(b.event_id) AS lifetime_high FROM (SELECT * FROM ev WHERE event_type = 'signup') a LEFT JOIN ev b ON b."character" = a."character" AND b.significance = 'high' AND b.ep <= a.ep GROUP BY 1""")
def lifetime_track(spark, sf_dir):
    """High evidence up to and with each episode, consumed or not; one window, no range join."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("character").orderBy("ep").rangeBetween(Window.unboundedPreceding, 0)
    high = F.count_if(F.col("significance") == "high").over(w)
    return evidence(spark, sf_dir).withColumn("lifetime_high", high).filter("event_type = 'signup'").select("event_id", "lifetime_high")


@query("""WITH g AS (SELECT l_returnflag AS method, round(avg(l_quantity), 4) AS mean, round(avg(l_quantity) - stddev_samp(l_quantity), 4) AS lo, round(avg(l_quantity) + stddev_samp(l_quantity), 4) AS hi FROM lineitem GROUP BY 1)
SELECT method, printf('%.2f (%.2f–%.2f)', mean, lo, hi) AS shown FROM g""")
def metric_cells(spark, sf_dir):
    from dramaturg.functions.prompts import with_interval

    s = scores(spark, sf_dir).groupBy("method").agg(F.round(F.avg("score"), 4).alias("m"), F.round(F.avg("score") - F.stddev_samp("score"), 4).alias("l"), F.round(F.avg("score") + F.stddev_samp("score"), 4).alias("h"))
    return s.select("method", with_interval(F.col("m"), F.col("l"), F.col("h"), 2).alias("shown"))
