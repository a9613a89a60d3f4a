"""Queries on corrections of relationships: claims and evidence of pairs made of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.operators import relations as R
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}
ROLES = {"view": "girlfriend", "click": "boyfriend", "purchase": "wife", "signup": "friend", "error": "ex-girlfriend"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ordinal(ts: str):
    """Seasons of ten days: the season times 100 plus the episode, so that neighbours differ by more than one at its end."""
    day = F.dayofmonth(ts) - 1
    return (100 * (1 + F.floor(day / 10)) + day % 10 + 1).cast("int")


def _pairs(spark, sf_dir, odd: int):
    """Events dealt to a data set of four users each and to a partner in it."""
    e = read(spark, sf_dir, "events").filter(F.col("event_id") % 2 == odd)
    return e.select(
        "event_id", F.floor(F.col("user_id") / 4).alias("dataset"), F.col("user_id").alias("owner"), _ordinal("ts").alias("ep"),
        F.col("user_id").bitwiseXOR(1 + F.col("event_id") % 3).alias("partner"), "event_type", "value",
    )


def claims(spark, sf_dir):
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    told = _pairs(spark, sf_dir, 0).withColumn("role", F.try_element_at(role, F.col("event_type")))
    return told.groupBy(*R.KEY).agg(F.max_by("role", "event_id").alias("role"))


def _events(spark, sf_dir):
    return _pairs(spark, sf_dir, 1)


def _cast(spark, sf_dir):
    """Three of a data set's four users are main characters."""
    users = _pairs(spark, sf_dir, 0).select("dataset", F.col("owner").alias("name"))
    return users.unionByName(_pairs(spark, sf_dir, 0).select("dataset", F.col("partner").alias("name"))).distinct().filter("name % 4 <> 3")


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())
_PAIR = "SELECT event_id, user_id // 4 AS dataset, user_id AS owner, CAST(100 * (1 + (day(ts) - 1) // 10) + (day(ts) - 1) % 10 + 1 AS INT) AS ep, xor(user_id, 1 + event_id % 3) AS partner, event_type, value FROM events"
_R = f"""c0 AS ({_PAIR} WHERE event_id % 2 = 0), e AS ({_PAIR} WHERE event_id % 2 = 1),
r AS (SELECT dataset, owner, ep, partner, arg_max(CASE event_type {_CASE} END, event_id) AS role FROM c0 GROUP BY 1, 2, 3, 4),
t AS (SELECT dataset, least(owner, partner) AS a, greatest(owner, partner) AS b, ep, event_type, event_id FROM e),
q AS (SELECT *, least(owner, partner) AS a, greatest(owner, partner) AS b, role IN ('girlfriend', 'boyfriend', 'wife') AS cur, role LIKE 'ex-%' AS former,
  lag(role) OVER (PARTITION BY dataset, owner, partner ORDER BY ep) AS old_role, min(ep) OVER (PARTITION BY dataset, owner, partner) AS since FROM r),
k AS (SELECT q.*, coalesce(x.cur, false) AS back_current, coalesce(x.former, false) AS back_former FROM q
  LEFT JOIN (SELECT dataset, ep, partner AS owner, owner AS partner, cur, former FROM q) x USING (dataset, ep, owner, partner))"""


def _last(kind: str, alias: str = "k") -> str:
    where = "" if kind == "any" else f" AND event_type = '{kind}'"
    return f"(SELECT max(t.ep) FROM t WHERE t.dataset = {alias}.dataset AND t.a = {alias}.a AND t.b = {alias}.b AND t.ep <= {alias}.ep{where})"


def _near(kind: str) -> str:
    return f"EXISTS (SELECT 1 FROM t WHERE t.dataset = q.dataset AND t.a = q.a AND t.b = q.b AND abs(t.ep - q.ep) <= 2 AND event_type = '{kind}')"


@query(f"WITH {_R} SELECT dataset, owner, ep, partner, role, back_current, back_former FROM k")
def pointing_back(spark, sf_dir):
    return R.pointing_back(claims(spark, sf_dir))


@query(f"""WITH {_R}, l AS (SELECT *, {_last('error')} AS lb, {_last('signup')} AS lr FROM k)
SELECT dataset, owner, ep, partner, CASE WHEN cur AND partner % 4 = 3 AND lb > coalesce(lr, -1) THEN 'ex-' || role ELSE role END AS role, coalesce(cur AND partner % 4 = 3 AND lb > coalesce(lr, -1), false) AS downgraded FROM l""")
def auto_ex_downgrade(spark, sf_dir):
    kind = F.col("event_type")
    return R.auto_downgraded(claims(spark, sf_dir), _events(spark, sf_dir), kind == "error", kind == "signup", _cast(spark, sf_dir))


_D = f"""c0 AS ({_PAIR} WHERE event_id % 2 = 0), e AS ({_PAIR} WHERE event_id % 2 = 1),
r AS (SELECT dataset, owner, ep, partner, arg_max(CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'crush' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'one-time encounter'
  WHEN event_type = 'purchase' AND event_id % 6 > 0 THEN 'dating' ELSE CASE event_type {_CASE} END END, event_id) AS role FROM c0 GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_D}, st AS (SELECT DISTINCT dataset, owner, ep FROM r), sp AS (SELECT *, lag(ep) OVER w AS before, lead(ep) OVER w AS after FROM st WINDOW w AS (PARTITION BY dataset, owner ORDER BY ep)),
f AS (SELECT r.*, min(r.ep) OVER (PARTITION BY r.dataset, r.owner, r.partner, r.role) AS since, r.partner % 4 <> 3 AND r.role NOT IN ('crush', 'one-time encounter') AS main,
  (SELECT max(t.ep) FROM st t WHERE t.dataset = r.dataset AND t.owner = r.partner AND t.ep <= r.ep) AS other_ep,
  EXISTS (SELECT 1 FROM r x JOIN sp USING (dataset, owner) WHERE sp.dataset = r.dataset AND sp.owner = r.owner AND sp.ep = r.ep AND x.ep = sp.before AND x.partner = r.partner AND x.role IN ('girlfriend', 'boyfriend', 'wife', 'dating')) AS held_before,
  EXISTS (SELECT 1 FROM r x JOIN sp USING (dataset, owner) WHERE sp.dataset = r.dataset AND sp.owner = r.owner AND sp.ep = r.ep AND x.ep = sp.after AND x.partner = r.partner AND x.role IN ('girlfriend', 'boyfriend', 'wife', 'dating')) AS held_after,
  (SELECT max(e.ep) FROM e WHERE e.dataset = r.dataset AND e.owner = r.owner AND e.partner = r.partner AND e.ep <= r.ep) AS seen,
  EXISTS (SELECT 1 FROM e WHERE e.dataset = r.dataset AND e.owner = r.owner AND e.partner = r.partner AND e.ep <= r.ep AND e.event_type = 'purchase' AND e.event_id % 3 = 0) AS married FROM r),
d AS (SELECT f.*, CASE WHEN f.role NOT IN ('girlfriend', 'boyfriend', 'dating', 'crush', 'one-time encounter') OR (held_before AND held_after) OR married THEN NULL
  WHEN main AND o.role LIKE 'ex-%' THEN 'listed_as_ex' WHEN main AND f.ep - since >= 10 AND NOT coalesce(o.role IN ('girlfriend', 'boyfriend', 'wife', 'dating', 'crush', 'one-time encounter'), false) THEN 'not_returned'
  WHEN NOT main AND f.ep - seen > 6 THEN 'forgotten' END AS rule FROM f LEFT JOIN r o ON o.dataset = f.dataset AND o.owner = f.partner AND o.partner = f.owner AND o.ep = f.other_ep)
SELECT dataset, owner, ep, partner, CASE WHEN rule IS NULL THEN role WHEN role = 'one-time encounter' THEN 'former ' || role ELSE 'ex-' || role END AS role, rule FROM d""")
def decay_rewrite(spark, sf_dir):
    """Fading roles by the partner's latest state, by silence, and by what shields them; three of a data set's four are its cast."""
    kind, n = F.col("event_type"), F.col("event_id")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    own = F.when((kind == "signup") & (n % 4 == 0), "crush").when((kind == "signup") & (n % 3 == 0), "one-time encounter").when((kind == "purchase") & (n % 6 > 0), "dating").otherwise(F.try_element_at(role, kind))
    told = _pairs(spark, sf_dir, 0).withColumn("role", own).groupBy(*R.KEY).agg(F.max_by("role", "event_id").alias("role"))
    events = _events(spark, sf_dir)
    return R.decayed(told, _cast(spark, sf_dir), events, events.filter((kind == "purchase") & (n % 3 == 0)))


_CUR_OLD = "coalesce(old_role IN ('girlfriend', 'boyfriend', 'wife'), false)"


@query(f"""WITH {_R}, s AS (SELECT *, former AND {_CUR_OLD} AND NOT {_near('error')} AS stripped FROM q)
SELECT dataset, owner, ep, partner, CASE WHEN stripped THEN old_role ELSE role END AS role, stripped FROM s""")
def unwarranted_ex(spark, sf_dir):
    return R.unwarranted_ex(claims(spark, sf_dir), _events(spark, sf_dir), F.col("event_type") == "error")


@query(f"""WITH {_R} SELECT n.dataset, n.owner, n.ep, n.partner, min(h.owner) AS lender FROM q n JOIN q h ON h.dataset = n.dataset AND h.partner = n.partner AND h.ep + 1 = n.ep AND h.cur AND h.owner <> n.owner
WHERE n.cur AND NOT coalesce(n.old_role IN ('girlfriend', 'boyfriend', 'wife'), false) GROUP BY 1, 2, 3, 4""")
def borrowed_partner_state(spark, sf_dir):
    return R.borrowed(claims(spark, sf_dir))


@query(f"WITH {_R} SELECT dataset, owner, ep, partner, role FROM q WHERE NOT cur OR {_CUR_OLD} OR {_near('view')}")
def inter_main_strip(spark, sf_dir):
    return R.corroborated(claims(spark, sf_dir), _events(spark, sf_dir), F.col("event_type") == "view")


_TIER = "CASE role WHEN 'wife' THEN 3 WHEN 'fiancée' THEN 2 WHEN 'girlfriend' THEN 1 WHEN 'boyfriend' THEN 1 ELSE 0 END"


@query(f"""WITH {_R}, l AS (SELECT dataset, owner, ep, partner, CASE WHEN role = 'wife' AND {_last('purchase')} IS NULL THEN CASE WHEN {_last('click')} IS NULL THEN 'girlfriend' ELSE 'fiancée' END ELSE role END AS role FROM k),
x AS (SELECT *, {_TIER} AS tier FROM l), y AS (SELECT x.*, (SELECT min(o.tier) FROM x o WHERE o.dataset = x.dataset AND o.ep = x.ep AND o.owner = x.partner AND o.partner = x.owner AND o.tier > 0) AS back FROM x)
SELECT dataset, owner, ep, partner, CASE WHEN tier > 0 AND back < tier THEN CASE back WHEN 2 THEN 'fiancée' ELSE 'girlfriend' END ELSE role END AS role FROM y""")
def status_tiers(spark, sf_dir):
    kind = F.col("event_type")
    return R.evidenced_tiers(claims(spark, sf_dir), _events(spark, sf_dir), kind == "click", kind == "purchase")


_STAYS = f"""{_R}, st AS (SELECT *, row_number() OVER (PARTITION BY dataset, owner ORDER BY ep) AS pos FROM (SELECT DISTINCT dataset, owner, ep FROM r)),
i AS (SELECT k.*, pos, pos - row_number() OVER (PARTITION BY dataset, owner, partner, role ORDER BY pos) AS i FROM k JOIN st USING (dataset, owner, ep) WHERE cur),
runs AS (SELECT dataset, owner, partner, role, min(pos) AS start, max(pos) AS stop, count(*) AS length, bool_or(back_current) AS returned FROM i GROUP BY dataset, owner, partner, role, i),
short AS (SELECT dataset, owner, partner, role, start, stop FROM runs WHERE length <= 3 AND NOT returned AND (NOT EXISTS (SELECT 1 FROM st WHERE st.dataset = runs.dataset AND st.owner = runs.owner AND st.pos > stop)
  OR EXISTS (SELECT 1 FROM st WHERE st.dataset = runs.dataset AND st.owner = runs.owner AND st.pos BETWEEN stop + 1 AND stop + 2
    AND NOT EXISTS (SELECT 1 FROM q WHERE q.dataset = runs.dataset AND q.owner = runs.owner AND q.partner = runs.partner AND q.ep = st.ep AND q.role = runs.role))))"""


@query(f"WITH {_STAYS} SELECT * FROM short")
def short_stay_runs(spark, sf_dir):
    return R.short_stays(claims(spark, sf_dir))


@query(f"""WITH {_STAYS} SELECT q.dataset, q.owner, q.ep, q.partner, CASE WHEN cur AND EXISTS (SELECT 1 FROM short s WHERE s.dataset = q.dataset AND s.owner = q.owner AND s.partner = q.partner AND s.role = q.role AND st.pos BETWEEN s.start AND s.stop)
  THEN 'friend' ELSE q.role END AS role FROM q JOIN st ON st.dataset = q.dataset AND st.owner = q.owner AND st.ep = q.ep""")
def short_stay_demotion(spark, sf_dir):
    return R.without_short_stays(claims(spark, sf_dir))


_INVERSE = "CASE role WHEN 'girlfriend' THEN 'boyfriend' WHEN 'boyfriend' THEN 'girlfriend' WHEN 'wife' THEN 'husband' END"


@query(f"""WITH {_STAYS}, w0 AS (SELECT dataset, owner, partner, role, unnest(range(start, stop + 1)) AS pos FROM runs WHERE length >= 2),
w AS (SELECT w0.dataset, st.ep, w0.partner AS owner, w0.owner AS partner, max({_INVERSE}) AS role FROM w0 JOIN st USING (dataset, owner, pos) GROUP BY 1, 2, 3, 4),
ad AS (SELECT w.* FROM w SEMI JOIN st USING (dataset, owner, ep) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.dataset = w.dataset AND q.owner = w.owner AND q.ep = w.ep AND q.partner = w.partner AND (cur OR former)))
SELECT dataset, owner, ep, partner, role, false AS added FROM r WHERE role <> 'friend' OR NOT EXISTS (SELECT 1 FROM ad WHERE ad.dataset = r.dataset AND ad.owner = r.owner AND ad.ep = r.ep AND ad.partner = r.partner)
UNION ALL SELECT dataset, owner, ep, partner, role, true FROM ad""")
def reciprocity_propagation(spark, sf_dir):
    return R.propagated(claims(spark, sf_dir))


@query(f"""WITH {_R}, st AS (SELECT DISTINCT dataset, owner, ep FROM r), nx AS (SELECT *, lead(ep) OVER (PARTITION BY dataset, owner ORDER BY ep) AS next FROM st),
x AS (SELECT r.dataset, r.owner, nx.next AS ep, r.partner, r.role FROM r JOIN nx USING (dataset, owner, ep) WHERE next IS NOT NULL AND role IN ('girlfriend', 'boyfriend', 'wife')),
br AS (SELECT dataset, owner, partner, min(ep) AS broke FROM e WHERE event_type = 'error' GROUP BY 1, 2, 3),
m AS (SELECT x.* FROM x ANTI JOIN r USING (dataset, owner, ep, partner))
SELECT dataset, owner, ep, partner, role, false AS restored FROM r UNION ALL
SELECT m.dataset, m.owner, m.ep, m.partner, m.role, true FROM m LEFT JOIN br USING (dataset, owner, partner) WHERE broke IS NULL OR broke > m.ep""")
def core_role_restore(spark, sf_dir):
    return R.restored(claims(spark, sf_dir), _events(spark, sf_dir).filter("event_type = 'error'"))


@query(f"""WITH {_R}, st AS (SELECT *, row_number() OVER (PARTITION BY dataset, owner ORDER BY ep) AS pos FROM (SELECT DISTINCT dataset, owner, ep FROM r)),
own AS (SELECT dataset, owner, ep, partner, role, CASE role WHEN 'wife' THEN 3 ELSE 1 END AS tier FROM r WHERE role IN ('girlfriend', 'boyfriend', 'wife')),
bk AS (SELECT dataset, partner AS owner, ep, owner AS partner, role AS back, tier AS back_tier FROM own),
oc AS (SELECT dataset, owner, ep, partner, role, tier, back, back_tier, pos, EXISTS (SELECT 1 FROM st m WHERE m.dataset = x.dataset AND m.owner = x.partner) AS main
  FROM (SELECT * FROM own FULL JOIN bk USING (dataset, owner, ep, partner)) x JOIN st USING (dataset, owner, ep)),
nx AS (SELECT *, lead(pos) OVER w AS npos, lead(ep) OVER w AS nep FROM oc WINDOW w AS (PARTITION BY dataset, owner, partner ORDER BY pos)),
gp AS (SELECT * FROM nx p WHERE role IS NOT NULL AND (NOT main OR back IS NOT NULL) AND npos - pos BETWEEN 2 AND 9
  AND EXISTS (SELECT 1 FROM oc z WHERE z.dataset = p.dataset AND z.owner = p.owner AND z.partner = p.partner AND z.pos BETWEEN p.npos AND p.npos + 2 AND z.tier >= p.tier AND (NOT p.main OR z.back_tier >= p.back_tier))
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.dataset = p.dataset AND t.a = least(p.owner, p.partner) AND t.b = greatest(p.owner, p.partner) AND t.event_type = 'error' AND t.event_id % 3 = 0 AND t.ep > p.ep AND t.ep <= p.nep)),
ins AS (SELECT g.dataset, g.owner, st.ep, g.partner, g.role, CASE WHEN g.main THEN g.back END AS back FROM (SELECT *, unnest(range(pos + 1, npos)) AS inner_pos FROM gp) g JOIN st ON st.dataset = g.dataset AND st.owner = g.owner AND st.pos = g.inner_pos),
al AS (SELECT dataset, owner, ep, partner, role, CASE WHEN owner < partner THEN 1 ELSE 0 END AS own FROM ins UNION ALL SELECT dataset, partner, ep, owner, back, CASE WHEN owner < partner THEN 1 ELSE 0 END FROM ins WHERE back IS NOT NULL),
ad0 AS (SELECT dataset, owner, ep, partner, arg_max(role, (own, role)) AS role FROM al SEMI JOIN st USING (dataset, owner, ep) GROUP BY 1, 2, 3, 4), ad AS (SELECT * FROM ad0 ANTI JOIN r USING (dataset, owner, ep, partner, role))
SELECT dataset, owner, ep, partner, role, false AS filled FROM r ANTI JOIN ad USING (dataset, owner, ep, partner) UNION ALL SELECT dataset, owner, ep, partner, role, true FROM ad""")
def continuity_written(spark, sf_dir):
    """Gaps of a bond that both sides take up again, unless a breakup lies in them."""
    broken = _events(spark, sf_dir).filter("event_type = 'error' AND event_id % 3 = 0").select("dataset", F.least("owner", "partner").alias("a"), F.greatest("owner", "partner").alias("b"), "ep")
    return R.gap_filled(claims(spark, sf_dir), broken=broken)


_ENT = """SELECT l_suppkey AS owner, l_orderkey AS state, l_linenumber AS place, l_partkey % 3 AS name,
  CASE l_partkey % 7 WHEN 0 THEN 'wife' WHEN 1 THEN 'ex-wife' WHEN 2 THEN 'boyfriend' WHEN 3 THEN 'ex-boyfriend' WHEN 4 THEN 'mother' WHEN 5 THEN 'neighbour' ELSE 'friend' END AS role FROM lineitem"""
_PRIORITY = "CASE role WHEN 'wife' THEN 100 WHEN 'ex-wife' THEN 70 WHEN 'boyfriend' THEN 80 WHEN 'ex-boyfriend' THEN 50 WHEN 'mother' THEN 95 WHEN 'friend' THEN 30 ELSE 20 END"


def _entries(spark, sf_dir):
    roles = F.array(*map(F.lit, ["wife", "ex-wife", "boyfriend", "ex-boyfriend", "mother", "neighbour", "friend"]))
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("state"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 3).alias("name"),
        F.get(roles, (F.col("l_partkey") % 7).cast("int")).alias("role"),
    )


@query(f"WITH n AS ({_ENT}) SELECT state, name, place, role FROM n QUALIFY row_number() OVER (PARTITION BY state, name ORDER BY {_PRIORITY} DESC, place, role) = 1")
def entries_by_role_priority(spark, sf_dir):
    return R.most_specific(_entries(spark, sf_dir), ["state", "name"], "place").select("state", "name", "place", "role")


@query(f"WITH n AS ({_ENT}) SELECT state, name, place, role FROM n QUALIFY row_number() OVER (PARTITION BY state, name ORDER BY CASE WHEN role LIKE 'ex-%' THEN 0 ELSE 1 END, place, role) = 1")
def entries_prefer_former(spark, sf_dir):
    return R.prefer_former(_entries(spark, sf_dir), ["state", "name"], "place").select("state", "name", "place", "role")


@query(f"WITH n AS ({_ENT}) SELECT state, place, role IN ('wife', 'boyfriend') AS current_romantic, role LIKE 'ex-%' AS former, CASE role WHEN 'wife' THEN 3 WHEN 'boyfriend' THEN 1 ELSE 0 END AS tier, {_PRIORITY} AS priority FROM n")
def role_predicates(spark, sf_dir):
    role = F.col("role")
    return _entries(spark, sf_dir).select(
        "state", "place", R.is_current_romantic(role).alias("current_romantic"), R.is_former(role).alias("former"), R.couple_tier(role).alias("tier"), R.role_priority(role).alias("priority")
    )


@query("""WITH p AS (SELECT p_partkey, 'Name' || chr(CAST(65 + p_partkey % 26 AS INT)) AS a, 'Other' || chr(CAST(65 + p_size % 26 AS INT)) AS b FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['friend is ' || a, 'friend is ' || b] WHEN 1 THEN ['fiancé is ' || a] WHEN 2 THEN ['friend is ' || a] ELSE ['boss is ' || a || ' (of ' || b || ')'] END AS entries FROM p""")
def legacy_entries(spark, sf_dir):
    letter = lambda c: F.char(65 + F.col(c) % 26)
    a, b, k = F.concat(F.lit("Name"), letter("p_partkey")), F.concat(F.lit("Other"), letter("p_size")), F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("friends are "), a, F.lit(" and "), b)).when(k == 1, F.concat(F.lit("Engaged to "), a)).when(k == 2, a)
        .otherwise(F.concat(F.lit(" boss is "), a, F.lit(" (of "), b, F.lit(")")))
    )
    return read(spark, sf_dir, "part").select("p_partkey", R.normalised_entry(text).alias("entries"))


def _steps(spark, sf_dir):
    from dramaturg.operators.steps import correction_steps

    kind = F.col("event_type")
    return correction_steps(_events(spark, sf_dir), kind == "error", kind == "signup", kind == "click", kind == "purchase", kind == "view")


@query()
def correction_pipeline(spark, sf_dir):
    """All corrections in their order: the claims that they changed."""
    from dramaturg.operators.steps import changed, run_steps
    from dramaturg.sources.scratch import cut

    before = cut(claims(spark, sf_dir))  # read by the first step and by the comparison
    return changed(before, run_steps(before, _steps(spark, sf_dir), cut)[0])
