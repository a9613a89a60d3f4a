"""Queries on vectors and on state over narrative time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.functions import text as T
from dramaturg.operators import retrieval as R
from dramaturg.operators import state as S
from dramaturg.plans.tables import EVIDENCE_SQL, evidence, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"


def _topk_sql(extra: str, k: int) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, p.vec_id, {_COS} AS s FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id {extra} WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, round(s, 5) AS similarity, place FROM r WHERE place <= {k}"""


def _topk(spark, sf_dir, k, exclude=None):
    pool = read(spark, sf_dir, "embeddings")
    found = R.top_k(pool, pool.filter("vec_id % 20 = 0"), k, exclude)
    return found.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "place")


@query(_topk_sql("", 5))
def cosine_topk(spark, sf_dir):
    return _topk(spark, sf_dir, 5)


@query(_topk_sql("AND q.label <> p.label", 3))
def cosine_topk_scene_excluded(spark, sf_dir):
    return _topk(spark, sf_dir, 3, "label")


@query("""WITH n AS (SELECT label, count(*) - 1 AS same FROM embeddings GROUP BY label)
SELECT count(*) AS queries, count(*) FILTER (same > 0) AS with_same_scene, round(avg(same), 6) AS mean_excluded, max(same) AS max_excluded FROM embeddings JOIN n USING (label)""")
def leak_diagnostics(spark, sf_dir):
    pool = read(spark, sf_dir, "embeddings")
    return R.leak_diagnostics(pool, pool, "label")


_CENTRES = """i AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m, count(*) AS size FROM i GROUP BY 1, 2), c AS (SELECT label, max(size) AS size, list(m ORDER BY i) AS centroid FROM m GROUP BY 1)"""


@query(f"""WITH {_CENTRES} SELECT a.label, a.size, round(avg(list_distance(a.centroid, b.centroid)) / (1 + a.size), 6) AS isolation FROM c a JOIN c b ON a.label <> b.label GROUP BY a.label, a.size""")
def cluster_isolation(spark, sf_dir):
    return R.isolation(R.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding"), "label")


@query(f"""WITH {_CENTRES}, d AS (SELECT e.label, vec_id, round(list_distance(e.embedding::DOUBLE[], centroid), 6) AS distance FROM embeddings e JOIN c USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS place FROM d) SELECT label, vec_id, distance, place FROM r WHERE place <= 3""")
def furthest_members(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return R.furthest_members(rows, R.centroids(rows, "label", "embedding"), "label", "embedding", 3)


@query("""WITH i AS (SELECT label, vec_id % 2 = 0 AS side, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT label, i, round(avg(CASE WHEN side THEN x END) - avg(CASE WHEN NOT side THEN x END), 6) AS delta, round(stddev_samp(x), 6) AS spread FROM i GROUP BY 1, 2""")
def mean_delta_vector(spark, sf_dir):
    return R.mean_difference(read(spark, sf_dir, "embeddings"), "label", F.col("vec_id") % 2 == 0, "embedding")


@query("SELECT vec_id, 1.0 AS length, round(list_max(embedding::DOUBLE[]) * 8 / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS largest FROM embeddings")
def scaled_unit_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("u", R.unit(F.col("embedding"), 8.0))
    return rows.select("vec_id", F.round(R.norm(F.col("u")) / 8, 5).alias("length"), F.round(F.array_max("u"), 5).alias("largest"))


@query()
def kmeans_three_way_split(spark, sf_dir):
    """Vectors clustered with the best silhouette of 3 to 9 clusters; a fifth of the rows each to ood and random."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made, _, _ = R.clustered(rows, "vec_id", "embedding", 10)
    n = rows.count() // 5
    return R.three_way_split(made, "vec_id", "cluster", "embedding", n, n).select("vec_id", "cluster", "split")


_SNAPS = "snap AS (SELECT user_id, epoch_us(ts) AS t, event_type AS state FROM events WHERE event_type IN ('signup', 'purchase')), smp AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view')"


@query(f"WITH {_SNAPS} SELECT event_id, smp.user_id, coalesce(state, 'p00') AS state FROM smp ASOF LEFT JOIN snap ON smp.user_id = snap.user_id AND smp.t > snap.t")
def asof_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    snapshots = e.filter(F.col("event_type").isin("signup", "purchase")).select("user_id", "ts", F.col("event_type").alias("state"))
    return S.as_of(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), snapshots, "user_id", "ts", "state", "p00").drop("ts")


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, f.t) AS event_type FROM events e JOIN (SELECT user_id, min(event_type) AS t FROM events GROUP BY 1) f USING (user_id)""")
def metadata_backfill(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    index = e.groupBy("user_id").agg(F.min("event_type").alias("event_type"))
    holes = e.select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return S.backfill(holes, index, "user_id", ["event_type"]).select("event_id", "event_type")


@query("""WITH u AS (SELECT user_id, list_slice(list(event_id ORDER BY event_id), 1, 3) || [-user_id - 1] AS ids FROM events GROUP BY 1),
c AS (SELECT user_id, unnest(ids) AS event_id, unnest(range(0, len(ids))) AS place FROM u)
SELECT c.user_id, string_agg(coalesce(event_type, '?'), ',' ORDER BY place) AS cited, count(*) FILTER (event_type IS NULL) AS n_missing FROM c LEFT JOIN events USING (event_id) GROUP BY c.user_id""")
def evidence_attach(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    first = F.slice(F.sort_array(F.collect_list("event_id")), 1, 3)
    updates = e.groupBy("user_id").agg(F.concat(first, F.array(-F.first("user_id") - 1)).alias("ids"))
    found = S.attach_evidence(updates, e, "user_id", "ids", "event_id", "event_type")
    return found.select("user_id", F.array_join(F.transform("evidence", lambda x: F.coalesce(x.event_type, F.lit("?"))), ",").alias("cited"), "n_missing")


@query(f"""WITH {EVIDENCE_SQL} SELECT "character", count(DISTINCT ep) AS episodes, count(*) FILTER (significance = 'high') AS high, count(*) FILTER (significance = 'medium') AS medium,
  count(*) FILTER (significance = 'high') >= 1 OR count(*) FILTER (significance = 'medium') >= 2 AS meets_low, count(DISTINCT ep) >= 3 AS meets_moderate,
  count(DISTINCT ep) >= 16 AND count(*) FILTER (significance = 'high') >= 6 AS meets_core FROM ev WHERE significance <> 'low' GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    return S.evidence_summary(evidence(spark, sf_dir).filter("significance <> 'low'"), "character")


@query(f"""WITH {EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY "character", significance ORDER BY ep DESC, event_id DESC) AS r FROM ev)
SELECT "character", event_id, ep, significance FROM r WHERE significance = 'high' OR (significance = 'medium' AND r <= 5)""")
def recent_n_evidence(spark, sf_dir):
    return S.recent_evidence(evidence(spark, sf_dir), "character", [F.desc("ep"), F.desc("event_id")], 5).select("character", "event_id", "ep", "significance")


@query(f"""WITH {EVIDENCE_SQL}, d AS (SELECT DISTINCT "character", ep FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY "character" ORDER BY ep) AS place, max(ep) OVER (PARTITION BY "character") AS last FROM d)
SELECT "character", ep, place FROM r WHERE place % 8 = 0 OR ep = last""")
def checkpoint_episodes(spark, sf_dir):
    return S.checkpoints(evidence(spark, sf_dir).select("character", "ep").distinct(), "character", 8)


@query(f"""WITH {EVIDENCE_SQL} SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'consumed' WHEN significance = 'medium' AND 30 - ep > 8 THEN 'expired' ELSE 'active' END AS status FROM ev""")
def evidence_status(spark, sf_dir):
    return evidence(spark, sf_dir).select("event_id", S.evidence_status(F.lit(30), F.col("event_type") == "purchase").alias("status"))


_PROPOSALS = f"""{EVIDENCE_SQL}, s AS (SELECT "character", count(DISTINCT ep) AS episodes, count(*) FILTER (significance = 'high') AS high, count(*) FILTER (significance = 'medium') AS medium FROM ev GROUP BY 1),
p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'core' END AS resistance, episodes, high, medium, CAST(event_id % 20 AS INT) AS since_update,
  repeat('x', CAST(event_id % 7 AS INT)) || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END AS new_value, repeat('x', CAST(event_id % 5 AS INT)) AS old_value, (event_id % 10) / 10.0 AS recall, CASE event_id % 4 WHEN 0 THEN 'replacement' ELSE 'merge' END AS merge_type,
  event_id % 11 <> 0 AS field_exists FROM ev JOIN s USING ("character"))"""


@query(f"""WITH {_PROPOSALS} SELECT event_id, CASE WHEN NOT field_exists THEN 'no_field'
  WHEN NOT CASE resistance WHEN 'low' THEN high >= 1 OR medium >= 2 WHEN 'moderate' THEN episodes >= 3 ELSE episodes >= 16 AND high >= 6 END THEN 'threshold'
  WHEN since_update < CASE resistance WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 ELSE 16 END THEN 'cooldown' WHEN trim(new_value) = '' THEN 'empty'
  WHEN merge_type <> 'replacement' AND old_value <> '' AND length(new_value) < 0.8 * length(old_value) THEN 'too_short' WHEN merge_type <> 'replacement' AND old_value <> '' AND recall < 0.5 THEN 'forgets'
  WHEN trim(new_value) = trim(old_value) THEN 'no_change' ELSE 'accepted' END AS decision FROM p""")
def update_gate(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    stats = ev.groupBy("character").agg(
        F.countDistinct("ep").alias("episodes"), F.count_if(F.col("significance") == "high").alias("high"), F.count_if(F.col("significance") == "medium").alias("medium")
    )
    i = F.col("event_id")
    x = lambda n: F.expr(f"repeat('x', cast(event_id % {n} as int))")
    p = ev.join(stats, "character").select(
        "event_id", "episodes", "high", "medium", F.when(i % 3 == 0, "low").when(i % 3 == 1, "moderate").otherwise("core").alias("resistance"), (i % 20).alias("since_update"),
        F.concat(x(7), F.when(i % 2 == 0, " ").otherwise("")).alias("new_value"), x(5).alias("old_value"), ((i % 10) / 10.0).alias("recall"), F.when(i % 4 == 0, "replacement").otherwise("merge").alias("merge_type"), (i % 11 != 0).alias("field_exists"),
    )
    return p.select("event_id", S.update_gate().alias("decision"))


_CLAIMS = "cl AS (SELECT DISTINCT user_id, event_type, CAST(day(ts) AS INT) AS ep FROM events)"
_RUNS = f"{_CLAIMS}, g AS (SELECT *, ep - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ep) AS island FROM cl), rn AS (SELECT user_id, event_type, min(ep) AS start, max(ep) AS stop, count(*) AS length FROM g GROUP BY user_id, event_type, island)"


def _claims(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("ep")).distinct()


@query(f"WITH {_RUNS} SELECT * FROM rn")
def claim_runs(spark, sf_dir):
    return S.runs(_claims(spark, sf_dir), ["user_id", "event_type"], "ep")


@query(f"WITH {_RUNS} SELECT user_id, event_type, start, stop FROM rn WHERE length <= 3 AND stop <= 28")
def short_stays(spark, sf_dir):
    return S.runs(_claims(spark, sf_dir), ["user_id", "event_type"], "ep").filter("length <= 3 and stop <= 28").select("user_id", "event_type", "start", "stop")


@query("""WITH d AS (SELECT user_id, CAST(day(ts) AS INT) AS ep, min(event_type) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
t AS (SELECT u.user_id, e.ep, d.v FROM (SELECT DISTINCT user_id FROM events) u JOIN (SELECT unnest(range(1, 31))::INT AS ep) e ON true LEFT JOIN d ON d.user_id = u.user_id AND d.ep = e.ep),
w AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN ep END) OVER (PARTITION BY user_id ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  min(CASE WHEN v IS NOT NULL THEN ep END) OVER (PARTITION BY user_id ORDER BY ep ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t)
SELECT w.user_id, w.ep, coalesce(w.v, CASE WHEN x.v = y.v AND w.a - w.b - 1 <= 3 THEN x.v END) AS filled FROM w LEFT JOIN t x ON x.user_id = w.user_id AND x.ep = w.b LEFT JOIN t y ON y.user_id = w.user_id AND y.ep = w.a""")
def continuity_fill(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    known = e.filter(F.col("event_type").isin("click", "view")).groupBy("user_id", F.dayofmonth("ts").alias("ep")).agg(F.min("event_type").alias("v"))
    timeline = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("ep")).join(known, ["user_id", "ep"], "left")
    return S.fill_gaps(timeline, "user_id", "ep", "v", 3).select("user_id", "ep", "filled")


@query(f"WITH {_CLAIMS} SELECT user_id, event_type, min(ep) AS first_seen FROM cl GROUP BY 1, 2")
def first_seen(spark, sf_dir):
    return S.first_seen(_claims(spark, sf_dir), ["user_id", "event_type"], "ep")


_DAILY = "dl AS (SELECT user_id, CAST(day(ts) AS INT) AS ep, max(event_type) AS v FROM events GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("ep")).agg(F.max("event_type").alias("v"))


@query(f"WITH {_DAILY}, l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ep) AS old_value FROM dl) SELECT user_id, ep, old_value, v FROM l WHERE old_value IS NOT NULL AND old_value <> v")
def version_diff(spark, sf_dir):
    return S.changes(_daily(spark, sf_dir), ["user_id"], "ep", "v").select("user_id", "ep", "old_value", "v")


@query(f"WITH {_DAILY} SELECT user_id, ep, coalesce(lag(v) OVER w = lead(v) OVER w, false) AS continuous FROM dl WINDOW w AS (PARTITION BY user_id ORDER BY ep)")
def neighbour_continuity(spark, sf_dir):
    return S.neighbours_agree(_daily(spark, sf_dir), ["user_id"], "ep", "v").select("user_id", "ep", "continuous")


@query(f"""WITH {EVIDENCE_SQL} SELECT event_id FROM ev o WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM ev c WHERE c.event_type = 'purchase' AND c."character" = o."character" AND abs(c.ep - o.ep) <= 2)""")
def band_join_evidence(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    return S.within_band(ev.filter("event_type = 'purchase'"), ev.filter("event_type = 'click'"), "character", "ep", 2).select("event_id")


_EDGES = "ed AS (SELECT l_partkey % 100 AS a, l_suppkey % 100 AS b, CAST(max(l_linenumber) % 3 + 1 AS INT) AS tier FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 100 AND l_quantity > 48 GROUP BY 1, 2)"


def _edges(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter("l_partkey % 100 <> l_suppkey % 100 and l_quantity > 48")  # noqa: E741
    return l.groupBy((F.col("l_partkey") % 100).alias("a"), (F.col("l_suppkey") % 100).alias("b")).agg((F.max("l_linenumber") % 3 + 1).cast("int").alias("tier"))


@query(f"WITH {_EDGES} SELECT a, b, tier FROM ed e WHERE NOT EXISTS (SELECT 1 FROM ed r WHERE r.a = e.b AND r.b = e.a)")
def reciprocity_gaps(spark, sf_dir):
    return S.unreciprocated(_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT e.a, e.b, e.tier, least(e.tier, coalesce(r.tier, e.tier)) AS aligned FROM ed e LEFT JOIN ed r ON r.a = e.b AND r.b = e.a")
def tier_alignment(spark, sf_dir):
    return S.aligned_tiers(_edges(spark, sf_dir))


_FACTS = f"""{_CLAIMS}, f AS (SELECT user_id, event_type, 30 - min(ep) AS age, 30 - max(ep) AS since_mention, CASE user_id % 9 WHEN 0 THEN 'ex-friend' ELSE 'friend' END AS role,
  user_id % 2 = 0 AS returned, user_id % 13 = 0 AS other_lists_ex, user_id % 17 = 0 AS continuous, user_id % 3 = 0 AS main, user_id % 19 = 0 AS married FROM cl GROUP BY user_id, event_type)"""


@query(f"""WITH {_FACTS} SELECT user_id, event_type, CASE WHEN role LIKE 'ex-%' OR continuous THEN 'keeps' WHEN other_lists_ex THEN 'listed_as_ex'
  WHEN age >= 10 AND NOT returned AND main AND NOT married THEN 'not_returned' WHEN (NOT main OR NOT returned) AND since_mention > 6 AND NOT married THEN 'forgotten' ELSE 'keeps' END AS rule FROM f""")
def decay_rules(spark, sf_dir):
    u = F.col("user_id")
    facts = _claims(spark, sf_dir).groupBy("user_id", "event_type").agg((30 - F.min("ep")).alias("age"), (30 - F.max("ep")).alias("since_mention"))
    facts = facts.withColumns({
        "role": F.when(u % 9 == 0, "ex-friend").otherwise("friend"), "returned": u % 2 == 0, "other_lists_ex": u % 13 == 0, "continuous": u % 17 == 0, "main": u % 3 == 0, "married": u % 19 == 0,
    })
    return facts.select("user_id", "event_type", S.decay().alias("rule"))


@query(f"""WITH {EVIDENCE_SQL} SELECT event_id, string_agg(event_type, chr(10) ORDER BY ep, event_id) OVER (PARTITION BY "character" ORDER BY ep, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM ev WHERE significance = 'high' AND event_type = 'purchase'""")
def cumulative_evidence(spark, sf_dir):
    high = evidence(spark, sf_dir).filter("significance = 'high' and event_type = 'purchase'")
    return S.cumulative_evidence(high, "character", ["ep", "event_id"], "event_type").select("event_id", "so_far")


@query(f"""WITH {EVIDENCE_SQL} SELECT event_id, CASE WHEN ep <= 2 THEN 'early' WHEN ep <= 5 THEN 'mid' ELSE 'late' END AS bucket,
  CASE event_type WHEN 'signup' THEN 'core' WHEN 'view' THEN 'relationships' WHEN 'click' THEN 'behavioral' ELSE 'factual' END AS stratum, printf('S%02dE%02d', 1 + ep // 10, ep % 10) AS tag,
  (1 + ep // 10) * 100 + ep % 10 AS ordinal FROM ev""")
def time_bucket_and_stratum(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    field = F.create_map(*[F.lit(x) for x in ("signup", "personality", "view", "relationships", "click", "behavioral_tendencies", "error", "hobby", "purchase", "job")])[F.col("event_type")]
    tag = T.episode_tag((F.floor(F.col("ep") / 10) + 1).cast("int"), F.col("ep") % 10)
    return ev.select("event_id", T.time_bucket(F.col("ep")).alias("bucket"), T.field_stratum(field).alias("stratum"), tag.alias("tag"), T.episode_ordinal(tag).alias("ordinal"))


@query()
def versions_by_evidence(spark, sf_dir):
    """A character's version rises with every third high event, in order; a window, as no rule reads other characters."""
    order = Window.partitionBy("character").orderBy(F.asc_nulls_last("ep"), F.asc_nulls_last("event_id"))
    high = evidence(spark, sf_dir).filter("significance = 'high'").withColumn("n", F.row_number().over(order)).filter("n % 3 = 0")
    return high.select((F.col("character") % 4).alias("dataset"), "character", "ep", F.floor(F.col("n") / 3).cast("int").alias("version"))


SQL["versions_by_evidence"] = f"""WITH {EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY "character" ORDER BY ep, event_id) AS n FROM ev WHERE significance = 'high')
SELECT "character" % 4 AS dataset, "character", ep, CAST(n // 3 AS INT) AS version FROM r WHERE n % 3 = 0"""

_WORDS = ["calm", "loyal", "witty", "stubborn", "gentle", "curious", "proud", "restless"]


@query()
def episode_fold(spark, sf_dir):
    """The fold of all rules over data sets of four characters: events are evidence, every second one also proposes an update.

    SQL can't say it: an update changes what later ones of its own and of other characters may do.
    """
    from dramaturg.operators.fold import fold

    e = read(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    kind, partner, dataset = F.col("event_type"), user.bitwiseXOR(1 + event % 3), F.floor(user / 4)
    told = e.select(
        dataset.alias("dataset"), user.alias("character"), F.dayofmonth("ts").alias("ep"), "event_id",
        F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "medium").otherwise("low").alias("significance"), partner.alias("partner"),
        F.when(kind == "error", "breakup").when(kind == "view", "romance").when(kind == "signup", "reconciliation").otherwise("other").alias("happening"),
    )
    field = F.when(kind == "click", "hobby").when(kind == "purchase", "style").when(kind == "signup", "traits").otherwise("relationships")
    resistance = F.when(field == "style", "moderate").when(field == "traits", "core").otherwise("low")
    pool = F.array(*map(F.lit, _WORDS))
    wordy = F.array_join(F.transform(F.sequence(F.lit(1), (2 + event % 5).cast("int")), lambda i: F.element_at(pool, ((i * (1 + (event / 3).cast("int") % 2)) % 8 + 1).cast("int"))), ", ")
    name = lambda c: F.concat(F.lit("U"), c.cast("string"))
    bonds = F.concat(F.when(kind == "error", "ex-girlfriend is ").otherwise("girlfriend is "), name(partner), F.lit(", friend is "), name(user.bitwiseXOR(1 + (event + 1) % 3)))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    asked = e.withColumn("cited", F.collect_list("event_id").over(before)).filter(event % 2 == 0).select(
        dataset.alias("dataset"), user.alias("character"), F.dayofmonth("ts").alias("ep"), event.alias("proposal_id"), field.alias("field"), resistance.alias("resistance"),
        F.when(field == "relationships", bonds).otherwise(wordy).alias("new_value"), F.when(event % 4 == 0, "replacement").otherwise("incremental").alias("merge_type"), "cited",
    )
    return fold(told, asked)


@query()
def resume_stream(spark, sf_dir):
    """Documents not yet labelled, as an available-now stream over the table's files."""
    from dramaturg.streaming.resume import run_resume

    return run_resume(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels").select("doc_id"), ["doc_id", "source"])


SQL["resume_stream"] = "SELECT DISTINCT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


@query()
def fold_stream(spark, sf_dir):
    """Each character's count of high events, kept in keyed state of a stream; equals the batch count."""
    from dramaturg.streaming.fold import run_fold

    return run_fold(spark, f"{sf_dir}/events.parquet")


SQL["fold_stream"] = f"""WITH {EVIDENCE_SQL} SELECT "character", count(*) AS high, max(ep) AS last_ep FROM ev WHERE significance = 'high' GROUP BY 1"""
