"""Queries on scores: merging, duplicates, summaries, comparisons, agreement, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions.special import paired_p_value, t_interval
from dramaturg.operators import agreement as A
from dramaturg.operators import evaluate as E
from dramaturg.plans.tables import read, scores

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MERGED = "FROM labels l LEFT JOIN (SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS similarity FROM embeddings) e USING (doc_id)"


def _merged(spark, sf_dir, zero_fill):
    sims = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("similarity"))
    return E.merge_scores(read(spark, sf_dir, "labels"), sims, "doc_id", "similarity", zero_fill)


@query(f"SELECT quality, count(*) AS n, round(avg(coalesce(similarity, 0.0)), 6) AS mean FROM (SELECT quality, similarity {_MERGED}) GROUP BY quality")
def merge_scores_zero_fill(spark, sf_dir):
    return _merged(spark, sf_dir, True).groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean"))


@query(f"SELECT quality, count(similarity) AS n, round(avg(similarity), 6) AS mean FROM (SELECT quality, similarity {_MERGED}) GROUP BY quality")
def merge_scores_skip_null(spark, sf_dir):
    return _merged(spark, sf_dir, False).groupBy("quality").agg(F.count("similarity").alias("n"), F.round(F.avg("similarity"), 6).alias("mean"))


_ALL = "l_shipdate, l_partkey, l_suppkey, l_extendedprice"


def _dedupe(spark, sf_dir, descending):
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return E.dedupe(scores(spark, sf_dir), ["l_orderkey", "l_linenumber"], order)


@query("""SELECT method, count(*) AS n, round(avg(score), 6) AS mean FROM (
  SELECT l_returnflag AS method, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY method""")
def dedupe_last_wins(spark, sf_dir):
    return _dedupe(spark, sf_dir, True).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, score FROM (
  SELECT l_orderkey, l_linenumber, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""")
def dedupe_first_split_wins(spark, sf_dir):
    order = [F.col("split"), *[F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]]
    return E.dedupe(scores(spark, sf_dir), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "score")


@query("SELECT l_returnflag AS method, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def pooled_mean_keep_all(spark, sf_dir):
    listed = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return scores(spark, sf_dir).join(listed, "l_orderkey", "left_semi").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


_SUMMARY = "count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS sd, round(coalesce(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 0), 4) AS sem FROM lineitem"


@query(f"SELECT l_returnflag AS method, {_SUMMARY} GROUP BY 1")
def method_summary(spark, sf_dir):
    return E.summary(scores(spark, sf_dir), ["method"], "score")


@query()
def method_summary_ci(spark, sf_dir):
    return t_interval(E.summary(scores(spark, sf_dir), ["method"], "score", 12), "n", "mean", "sem")


@query(f"SELECT l_returnflag AS method, l_linestatus AS split, {_SUMMARY} GROUP BY 1, 2")
def per_split_summary(spark, sf_dir):
    return E.summary(scores(spark, sf_dir), ["method", "split"], "score")


@query("SELECT l_returnflag AS method, o_orderpriority AS role, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def per_role_means(spark, sf_dir):
    roles = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("role"))
    return scores(spark, sf_dir).join(roles, "l_orderkey").groupBy("method", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query("""SELECT o_orderpriority AS role, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 100""")
def min_count_roles(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")


# sums in decimals don't depend on the order of rows, and gaps that agree to nine digits tie
_DELTAS = """m AS (SELECT user_id, event_type AS method, sum(value::DECIMAL(18, 6))::DOUBLE / count(value) AS v FROM events GROUP BY 1, 2),
d AS (SELECT a.user_id, a.method, round(a.v - b.v, 9) AS delta FROM m a JOIN m b USING (user_id) WHERE b.method = 'view' AND a.method <> 'view')"""


def _deltas(spark, sf_dir):
    means = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("method")).agg(E.exact_mean("value").alias("v"))
    return E.pairs(means, ["user_id"], "method", "v", "view").withColumn("delta", F.round("delta", 9))


@query(f"""WITH {_DELTAS} SELECT method, count(*) AS n, round(avg(delta), 6) AS delta, round(avg(delta) / stddev_samp(delta), 6) AS cohen_d,
  round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties,
  count(*) FILTER (delta < 0) AS losses, round(count(*) FILTER (delta > 0) * 100.0 / count(*), 1) AS win_pct FROM d GROUP BY method""")
def paired_comparison(spark, sf_dir):
    return E.paired_comparison(_deltas(spark, sf_dir), "method")


@query(f"""WITH {_DELTAS}, r AS (SELECT method, delta, rank() OVER (PARTITION BY method ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY method, abs(delta)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY method, abs(delta)) AS k FROM d WHERE delta <> 0),
s AS (SELECT method, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, sum(k * k - 1) AS ties FROM r GROUP BY method)
SELECT method, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""")
def wilcoxon_w(spark, sf_dir):
    return E.wilcoxon(_deltas(spark, sf_dir), "method")


@query()
def paired_p_values(spark, sf_dir):
    deltas = _deltas(spark, sf_dir)
    joined = E.paired_comparison(deltas, "method", 12).select("method", "n", "t").join(E.wilcoxon(deltas, "method").select("method", "z"), "method", "left")
    return paired_p_value(joined)


@query("""SELECT method, count(*) AS groups, round(avg(m), 6) AS macro FROM (SELECT l_returnflag AS method, l_suppkey AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def macro_average(spark, sf_dir):
    return E.macro_average(scores(spark, sf_dir), "method", "l_suppkey", "score")


_CELLS = "c AS (SELECT l_suppkey AS dataset, l_returnflag AS method, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_CELLS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS k FROM c)
SELECT dataset, method, mean, CASE k WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM r""")
def best_second(spark, sf_dir):
    cells = scores(spark, sf_dir).groupBy(F.col("l_suppkey").alias("dataset"), "method").agg(F.round(F.avg("score"), 4).alias("mean"))
    return E.best_marks(cells, ["dataset"], "mean")


@query(f"WITH {_CELLS} SELECT dataset, max(CASE method WHEN 'A' THEN mean END) AS A, max(CASE method WHEN 'N' THEN mean END) AS N, max(CASE method WHEN 'R' THEN mean END) AS R FROM c GROUP BY dataset")
def paper_pivot_table(spark, sf_dir):
    return E.table_of(scores(spark, sf_dir).withColumnRenamed("l_suppkey", "dataset"), ["dataset"], "method", ["A", "N", "R"], "score")


_STATS = """SELECT source, lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std, min(n_chars) AS min, max(n_chars) AS max,
  round(median(n_chars), 4) AS median, sum(n_chars) AS total FROM documents GROUP BY 1, 2"""


@query(_STATS)
def text_length_stats(spark, sf_dir):
    return E.describe(read(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")


@query(f"""SELECT source, sum(n) AS n, round(sum(mean * n) / sum(n), 3) AS mean, round(sum(std * n) / sum(n), 3) AS std, round(sum(median * n) / sum(n), 3) AS median,
  min(min) AS min, max(max) AS max, sum(total) AS total FROM ({_STATS}) GROUP BY source""")
def weighted_stats_merge(spark, sf_dir):
    return E.merge_descriptions(text_length_stats(spark, sf_dir), ["source"])


@query("""SELECT event_type, round(sum(value), 4) AS total_seconds, sum(user_id) AS samples, round(sum(value) * 1000 / sum(user_id), 4) AS ms_per_sample,
  round(sum(user_id) / sum(value), 4) AS samples_per_second FROM events GROUP BY 1 HAVING sum(user_id) > 0""")
def latency_rollup(spark, sf_dir):
    return E.latency(read(spark, sf_dir, "events"), "event_type", "value", "user_id")


_XY = "xy AS (SELECT event_type, value AS x, CAST(json_extract(props, '$.k') AS INT) AS y FROM events)"


def _xy(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))


@query(f"WITH {_XY} SELECT event_type, count(*) AS n, round(corr(x, y), 6) AS r FROM xy GROUP BY 1")
def pearson(spark, sf_dir):
    return A.pearson(_xy(spark, sf_dir), ["event_type"], "x", "y")


@query(f"""WITH {_XY}, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0 AS b FROM xy)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    return A.spearman(_xy(spark, sf_dir), ["event_type"], "x", "y")


@query("""WITH l AS (SELECT doc_id, quality::DOUBLE AS v FROM labels UNION ALL SELECT doc_id, (1 - toxic)::DOUBLE FROM labels),
o AS (SELECT avg(2 * s) AS o, count(*) AS u FROM (SELECT doc_id, var_samp(v) AS s FROM l GROUP BY 1)), e AS (SELECT 2 * var_samp(v) AS e FROM l)
SELECT u AS units, round(1 - o / e, 6) AS alpha FROM o, e""")
def krippendorff_alpha(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return A.krippendorff(l.select("doc_id", F.explode(F.array(F.col("quality"), 1 - F.col("toxic"))).alias("v")), "doc_id", "v")


@query("""WITH c AS (SELECT doc_id % 4 AS part, avg((quality = 1)::INT) AS a, avg((toxic = 0)::INT) AS b, avg(((quality = 1) = (toxic = 0))::INT) AS s, count(*) AS n FROM labels GROUP BY 1)
SELECT part, n, round(s, 6) AS agreement, round((s - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM c""")
def cohen_kappa(spark, sf_dir):
    l = read(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("part"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))  # noqa: E741
    return A.cohen_kappa(l, ["part"], "a", "b")


_THREE = """r AS (SELECT doc_id, quality AS a, 1 - toxic AS b, CAST(doc_id % 3 = 0 AS INT) AS c FROM labels),
l AS (SELECT doc_id, CASE x WHEN 1 THEN 'supported' ELSE 'unsupported' END AS label FROM (SELECT doc_id, unnest([a, b, c]) AS x FROM r))"""


def _three(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    marks = F.array(F.col("quality"), 1 - F.col("toxic"), (F.col("doc_id") % 3 == 0).cast("int"))
    return l.select("doc_id", F.explode(marks).alias("x")).select("doc_id", F.when(F.col("x") == 1, "supported").otherwise("unsupported").alias("label"))


@query(f"""WITH {_THREE}, c AS (SELECT doc_id, label, count(*) AS c FROM l GROUP BY 1, 2), i AS (SELECT doc_id, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1),
p AS (SELECT avg((sq - n) / (n * (n - 1))) AS p, count(*) AS items, sum(n) AS m FROM i), s AS (SELECT sum(t * t) AS s FROM (SELECT sum(c) AS t FROM c GROUP BY label))
SELECT items, round((p - s / (m * m)) / (1 - s / (m * m)), 6) AS kappa FROM p, s""")
def fleiss_kappa(spark, sf_dir):
    return A.fleiss_kappa(_three(spark, sf_dir), "doc_id", "label")


@query(f"WITH {_THREE} SELECT doc_id, CASE WHEN count(*) FILTER (label = 'supported') >= 2 THEN 'supported' ELSE 'unsupported' END AS consensus FROM l GROUP BY doc_id")
def majority_vote(spark, sf_dir):
    return A.majority(_three(spark, sf_dir), "doc_id", "label")


@query(f"""WITH {_THREE}, s AS (SELECT doc_id % 5 AS corpus, doc_id, count(*) FILTER (label = 'supported') AS k FROM l GROUP BY 1, 2)
SELECT corpus, count(*) AS n, round(avg((k >= 2)::INT) * 100, 4) AS supported_pct, round(avg(k / 3.0), 6) AS mean FROM s GROUP BY corpus""")
def corpus_consensus(spark, sf_dir):
    per_item = _three(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("corpus"), "doc_id").agg(F.count_if(F.col("label") == "supported").alias("k"))
    return per_item.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("k") >= 2).cast("int")) * 100, 4).alias("supported_pct"), F.round(F.avg(F.col("k") / 3.0), 6).alias("mean")
    )


_GAPS = """g AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) - avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS x,
  avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) - avg(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS y FROM lineitem GROUP BY 1)"""


@query(f"WITH {_GAPS} SELECT l_suppkey % 5 AS track, count(*) AS n, round(avg((sign(x) = sign(y))::INT), 6) AS agreement FROM g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def direction_agreement(spark, sf_dir):
    mean = lambda m, c: F.avg(F.when(F.col("method") == m, F.col(c)))
    gaps = scores(spark, sf_dir).groupBy("l_suppkey").agg((mean("A", "score") - mean("N", "score")).alias("x"), (mean("A", "l_extendedprice") - mean("N", "l_extendedprice")).alias("y"))
    return A.direction_agreement(gaps.filter("x is not null and y is not null").withColumn("track", F.col("l_suppkey") % 5), ["track"], "x", "y")


@query(f"WITH {_CELLS} SELECT dataset, arg_max(method, (mean, method)) AS best, max(mean) AS mean FROM c WHERE method <> 'A' GROUP BY dataset")
def best_baseline(spark, sf_dir):
    cells = scores(spark, sf_dir).filter("method <> 'A'").groupBy(F.col("l_suppkey").alias("dataset"), "method").agg(F.round(F.avg("score"), 4).alias("mean"))
    return cells.groupBy("dataset").agg(F.max_by("method", F.struct("mean", "method")).alias("best"), F.max("mean").alias("mean"))


@query(r"""SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def lookup_profiles(spark, sf_dir):
    names = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
