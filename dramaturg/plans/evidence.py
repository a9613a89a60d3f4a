"""Queries on what summaries say of two people, and on changes held against the scenes that they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import pair_evidence as E
from dramaturg.operators import cited as C
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


NAMES = ["Ana", "Bo-Lin", "C.J.", "D'Arcy", "Élodie", "F++"]
#: What a summary may say of two people; the comments name what each is evidence of.
SHAPES = [
    "{a} broke up with {b}.",  # breakup
    "{a} decided to leave the dinner to be with {b}.",  # nothing: the one goes to the other
    "{a} comforted {b} after the end of the relationship with Julie.",  # nothing: somebody else's
    "{a} and {b} got back together.",  # reconciliation
    "{a} proposes to {b}. {a} tells of their engagement.",  # reconciliation, engagement
    "{a} is planning to propose to {b}. {a} is newly engaged in work.",  # nothing: only planned
    "{a} marries {b}.",  # reconciliation, marriage
    "{a} and {b} exchanged vows. The honeymoon begins.",  # marriage
    "{a} and {b} choose a wedding venue and exchanged vows. The honeymoon begins.",  # nothing: a discard in the sentence
    "{a} and {b} move in together.",  # reconciliation, settled
    "{a} met a stranger. They broke up.",  # nothing: not of the two
    "Since the end of their romance {a} avoids {b}.",  # breakup
    "{a} stood by, encouraging a friend to date {b}.",  # breakup: gives up
    "{a} waved to {b}.",
]


def _said(shape, a, b):
    """The sentence of the shape's number about two names."""
    text = F.element_at(F.array(*map(F.lit, SHAPES)), (shape + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{a}"), a), F.lit("{b}"), b)


def _name(i):
    return F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int"))


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 14 AS shape FROM conversations)
SELECT conv_id, turn, shape IN (0, 11, 12) AS breakup, shape IN (3, 4, 6, 9) AS reconciliation, shape = 4 AS engagement, shape IN (6, 7) AS marriage, shape = 9 AS settled FROM c""")
def text_evidence(spark, sf_dir):
    """Turns as summaries, with sentences of fourteen shapes about two of six names before and after the turn's own text."""
    c = read(spark, sf_dir, "conversations")
    a, b, other = _name(F.col("conv_id")), _name(F.col("conv_id") + F.col("turn") % 5 + 1), _name(F.col("conv_id") + F.col("turn") % 5 + 1 + 6)
    told = _said((F.col("conv_id") + F.col("turn")) % len(SHAPES), a, other)
    text = F.concat(F.lit("The scene opens. "), told, F.lit(" "), F.coalesce("text", F.lit("")))
    return c.select(
        "conv_id", "turn", E.has_breakup(text, a, b).alias("breakup"), E.has_reconciliation(text, a, b).alias("reconciliation"), E.has_engagement(text, a, b).alias("engagement"),
        E.has_marriage(text, a, b).alias("marriage"), E.has_settled(text, a, b).alias("settled"),
    )


def _cast_name(user):
    return F.element_at(F.array(*map(F.lit, NAMES[:4])), (user % 4 + 1).cast("int"))


def _scenes(spark, sf_dir):
    """Even events as scenes: one of a data set's four characters with another, in one of the shapes."""
    e = read(spark, sf_dir, "events").filter(F.col("event_id") % 2 == 0)
    owner, partner = _cast_name(F.col("user_id")), _cast_name(F.col("user_id").bitwiseXOR(1 + F.col("event_id") % 3))
    return e.select(
        F.floor(F.col("user_id") / 4).alias("dataset"), owner.alias("character"), F.dayofmonth("ts").alias("ep"), F.col("event_id").alias("scene_id"),
        _said(F.floor(F.col("event_id") / 2) % len(SHAPES), owner, partner).alias("summary"),
    )


def _changes(spark, sf_dir, partner, role):
    """Odd errors as changes of a bond, which cite the character's scenes of the day and of the day before."""
    e = read(spark, sf_dir, "events").filter("event_id % 2 = 1 AND event_type = 'error'")
    own = e.select(F.floor(F.col("user_id") / 4).alias("dataset"), _cast_name(F.col("user_id")).alias("owner"), F.dayofmonth("ts").alias("ep"), partner.alias("partner"), F.lit(role).alias("role")).distinct()
    ids = _scenes(spark, sf_dir).select("dataset", F.col("character").alias("owner"), F.explode(F.array(F.col("ep"), F.col("ep") + 1)).alias("ep"), "scene_id")
    ids = ids.groupBy("dataset", "owner", "ep").agg(F.sort_array(F.collect_list("scene_id")).alias("cited"))
    return own.join(ids, ["dataset", "owner", "ep"], "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>")))


_CAST = "(['Ana', 'Bo-Lin', 'C.J.', 'D''Arcy'])[CAST({} % 4 + 1 AS INT)]"
_SCENES = f"""sc AS (SELECT user_id // 4 AS dataset, {_CAST.format('user_id')} AS "character", CAST(day(ts) AS INT) AS ep, event_id AS scene_id,
  {_CAST.format('xor(user_id, 1 + event_id % 3)')} AS partner, event_id // 2 % 14 AS shape FROM events WHERE event_id % 2 = 0)"""


@query(f"""WITH {_SCENES}, ch AS (SELECT DISTINCT user_id // 4 AS dataset, {_CAST.format('user_id')} AS owner, CAST(day(ts) AS INT) AS ep, {_CAST.format('xor(user_id, 1 + event_id % 3)')} AS partner FROM events WHERE event_id % 2 = 1 AND event_type = 'error'),
ci AS (SELECT ch.*, sc.scene_id, sc.ep AS scene_ep, sc.partner AS told, sc.shape FROM ch JOIN sc ON sc.dataset = ch.dataset AND sc."character" = ch.owner AND sc.ep BETWEEN ch.ep - 1 AND ch.ep),
ok AS (SELECT dataset, owner, ep, partner FROM ci WHERE told = partner AND shape IN (0, 11, 12)
  UNION SELECT ci.dataset, ci.owner, ci.ep, ci.partner FROM ci JOIN sc ON sc.dataset = ci.dataset AND sc."character" = ci.partner AND abs(sc.ep - ci.scene_ep) <= 2 WHERE sc.shape IN (0, 11, 12) AND sc.partner = ci.owner)
SELECT ch.dataset, ch.owner, ch.ep, ch.partner, 'ex-girlfriend' AS role, ok.dataset IS NOT NULL AS warranted FROM ch LEFT JOIN ok USING (dataset, owner, ep, partner)""")
def unwarranted_ex_cited(spark, sf_dir):
    """Former roles that need a breakup told in a cited scene, or in the partner's archive close to one."""
    changes = _changes(spark, sf_dir, _cast_name(F.col("user_id").bitwiseXOR(1 + F.col("event_id") % 3)), "ex-girlfriend")
    return C.unwarranted_ex(changes, _scenes(spark, sf_dir)).select(*C.CHANGE, "warranted")


_OUT = "(['Paolo', 'Quin', 'Rex'])[CAST({} % 3 + 1 AS INT)]"


@query(f"""WITH s0 AS (SELECT user_id // 4 AS dataset, user_id % 4 AS o, CAST(day(ts) AS INT) AS ep, event_id, {_OUT.format('event_id // 2')} AS guest, event_id // 6 % 5 AS shape, (user_id + 1 + event_id // 30 % 3) % 4 AS other FROM events WHERE event_id % 2 = 0),
v AS (SELECT dataset, o, ep, event_id, guest, CASE WHEN shape IN (0, 1, 4) THEN {_CAST.format('other')} END AS lender, CASE WHEN shape = 2 THEN 1 ELSE 0 END AS own FROM s0),
ch AS (SELECT DISTINCT user_id // 4 AS dataset, user_id % 4 AS o, {_CAST.format('user_id')} AS owner, CAST(day(ts) AS INT) AS ep, {_OUT.format('event_id')} AS partner FROM events WHERE event_id % 2 = 1 AND event_type = 'error'),
ci AS (SELECT ch.dataset, ch.owner, ch.ep, ch.partner, v.lender, v.own FROM ch JOIN v ON v.dataset = ch.dataset AND v.o = ch.o AND v.ep BETWEEN ch.ep - 1 AND ch.ep AND v.guest = ch.partner),
n AS (SELECT dataset, owner, ep, partner, lender, count(*) AS votes FROM ci WHERE lender IS NOT NULL GROUP BY ALL),
w AS (SELECT dataset, owner, ep, partner, sum(own) AS own_votes FROM ci GROUP BY ALL)
SELECT dataset, owner, ep, partner, 'boyfriend' AS role, votes, CAST(own_votes AS BIGINT) AS own_votes, lender FROM n JOIN w USING (dataset, owner, ep, partner) WHERE votes > own_votes
QUALIFY row_number() OVER (PARTITION BY dataset, owner, ep, partner ORDER BY votes DESC, lender) = 1""")
def borrowed_partner_votes(spark, sf_dir):
    """Guests whom the cited scenes give to another main character more often than they put them beside the owner."""
    e = read(spark, sf_dir, "events").filter(F.col("event_id") % 2 == 0)
    half = F.floor(F.col("event_id") / 2)
    guests = F.array(*map(F.lit, ["Paolo", "Quin", "Rex"]))
    guest = lambda n: F.element_at(guests, (n % 3 + 1).cast("int"))
    other = _cast_name(F.col("user_id") + 1 + F.floor(F.col("event_id") / 30) % 3)
    owner = _cast_name(F.col("user_id"))
    shape = F.floor(F.col("event_id") / 6) % 5
    summary = (
        F.when(shape == 0, F.concat(other, F.lit("'s new friend "), guest(half), F.lit(" came.")))
        .when(shape == 1, F.concat(owner, F.lit(" supported "), other, F.lit(" through her breakup with "), guest(half), F.lit(".")))
        .when(shape == 2, F.concat(owner, F.lit(" met "), guest(half), F.lit(".")))
        .when(shape == 3, F.concat(guest(half), F.lit(" left the town.")))
        .otherwise(F.concat(guest(half), F.lit(" and "), other, F.lit(" danced; "), owner, F.lit(" watched.")))
    )
    scenes = e.select(F.floor(F.col("user_id") / 4).alias("dataset"), owner.alias("character"), F.dayofmonth("ts").alias("ep"), F.col("event_id").alias("scene_id"), summary.alias("summary"))
    cast = scenes.select("dataset").distinct().select("dataset", F.explode(F.array(*map(F.lit, NAMES[:4]))).alias("name"))
    changes = _changes(spark, sf_dir, guest(F.col("event_id")), "boyfriend")
    return C.borrowed_by_votes(changes, scenes, cast)


#: Days, high evidence and rest by tier; a character of the table has little high evidence.
CITED_GATES = {"low": (0, 1, 2), "moderate": (3, 0, 3), "core": (6, 2, 16)}
_EVENT = """ev AS (SELECT user_id // 40 AS dataset, user_id AS "character", CAST(day(ts) AS INT) AS ep, event_id, event_type, value,
  's' || lpad(CAST(1 + day(ts) // 16 AS VARCHAR), 2, '0') || '_e' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '_c' || CASE WHEN event_id < 10 THEN '0' ELSE '' END || event_id AS scene_id FROM events),
t AS (SELECT dataset, "character", ep, scene_id, event_id, CASE WHEN value >= 150 THEN 'high' ELSE 'medium' END AS sig,
  CASE WHEN event_type = 'purchase' THEN 'consumed' WHEN value < 150 AND ep < 6 THEN 'expired' ELSE 'active' END AS status FROM ev WHERE event_type <> 'signup' AND value >= 40)"""


@query(f"""WITH {_EVENT}, p AS (SELECT dataset, "character", ep, event_id AS proposal_id, CASE event_id % 5 WHEN 0 THEN 'mood' WHEN 1 THEN 'goal' WHEN 2 THEN 'belief' WHEN 3 THEN 'food' ELSE 'shadow' END AS field,
  CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'core' WHEN 3 THEN 'low' END AS resistance, CASE WHEN event_id % 3 > 0 THEN ep - event_id % 7 END AS updated_at, event_id // 5 % 7 AS way,
  CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 29 WHEN 3 THEN 3 ELSE 2 END AS reach FROM ev WHERE event_type = 'signup'),
m AS (SELECT *, count(*) FILTER (status = 'active' AND sig = 'medium') OVER (PARTITION BY dataset, "character" ORDER BY ep, scene_id ROWS UNBOUNDED PRECEDING) AS nth FROM t),
c AS (SELECT p.*, m.scene_id, m.ep AS scene_ep, m.sig FROM p JOIN m ON m.dataset = p.dataset AND m."character" = p."character" AND m.ep BETWEEN p.ep - p.reach AND p.ep
  WHERE m.event_id % 6 <> 5 AND ((m.sig = 'high' AND (m.status = 'active' OR p.resistance IN ('moderate', 'core')))
    OR (m.sig = 'medium' AND m.status = 'active' AND m.nth > (SELECT count(*) FROM t x WHERE x.dataset = p.dataset AND x."character" = p."character" AND x.sig = 'medium' AND x.status = 'active' AND x.ep <= p.ep) - 20))),
g AS (SELECT proposal_id, string_agg(scene_id, ',' ORDER BY scene_id) AS ids, count(DISTINCT scene_ep) AS episodes, count(*) FILTER (sig = 'high') AS high, count(*) FILTER (sig = 'medium') AS medium FROM c GROUP BY 1)
SELECT p.dataset, p."character", p.ep, p.proposal_id, field, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN 'no_evidence' WHEN resistance IS NULL THEN 'no_field'
  WHEN resistance = 'low' AND high < 1 AND medium < 2 THEN 'few_events' WHEN resistance = 'moderate' AND episodes < 3 OR resistance = 'core' AND episodes < 6 THEN 'few_episodes' WHEN resistance = 'core' AND high < 2 THEN 'few_high'
  WHEN p.ep - updated_at < CASE resistance WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 ELSE 16 END THEN 'cooldown'
  WHEN way = 0 THEN 'empty' WHEN way = 1 THEN 'too_short' WHEN way = 2 THEN 'forgets' WHEN way = 3 THEN 'no_change' ELSE 'accepted' END AS decision
FROM p LEFT JOIN g USING (proposal_id)""")
def update_gate_cited(spark, sf_dir):
    """Proposals that cite scenes in four ways of writing: ids allowed by tier, thresholds, rest, and the value's own checks."""
    from dramaturg.operators import gate as G

    e = read(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    scene = F.concat(F.lit("s"), two(F.floor(1 + day / 16)), F.lit("_e"), two(day), F.lit("_c"), two(F.col("event_id")))
    e = e.select(F.floor(F.col("user_id") / 40).alias("dataset"), F.col("user_id").alias("character"), day.alias("ep"), "event_id", "event_type", "value", scene.alias("scene_id"))
    told = e.filter("event_type <> 'signup' and value >= 40")
    status = F.when(F.col("event_type") == "purchase", "consumed").when((F.col("value") < 150) & (F.col("ep") < 6), "expired").otherwise("active")
    evidence = told.select("dataset", "character", "scene_id", "ep", F.when(F.col("value") >= 150, "high").otherwise("medium").alias("significance"), status.alias("status"))
    i = F.col("event_id")
    n, way = i % 5, F.floor(i / 5) % 7
    old = F.lit("walks along the harbour at night")
    new = (
        F.when(way == 0, "  ").when(way == 1, "walks").when(way == 2, "entirely different pastimes and meals").when(way == 3, F.concat(F.lit(" "), old)).when(way == 4, F.concat(old, F.lit(", chess"))).otherwise("chess")
    )
    asked = e.filter("event_type = 'signup'").select(
        "dataset", "character", "ep", i.alias("proposal_id"), F.element_at(F.array(*map(F.lit, ["mood", "goal", "belief", "food", "shadow"])), (n + 1).cast("int")).alias("field"),
        F.when(n.isin(0, 3), "low").when(n == 1, "moderate").when(n == 2, "core").alias("resistance"), F.when(i % 3 > 0, F.col("ep") - i % 7).alias("updated_at"),
        F.when(way == 6, "").otherwise(old).alias("old_value"), new.alias("new_value"), F.when(way == 5, "replacement").when(way == 4, "incremental").alias("merge_type"),
        F.when(n == 0, 1).when(n == 1, 9).when(n == 2, 29).when(n == 3, 3).otherwise(2).alias("reach"),
    )
    # each way of writing an id, and one that names none
    written = (
        F.when(i % 6 == 0, F.col("scene_id")).when(i % 6 == 1, F.upper(F.replace("scene_id", F.lit("_e"), F.lit("E")))).when(i % 6 == 2, F.concat(F.lit("Scene "), F.replace("scene_id", F.lit("_"), F.lit("-"))))
        .when(i % 6 == 3, F.concat(F.lit("see "), F.replace("scene_id", F.lit("_"), F.lit(" ")), F.lit(", twice "), F.col("scene_id"))).when(i % 6 == 4, F.concat(F.lit("scene="), F.col("scene_id"))).otherwise("none")
    )
    ids = told.select("dataset", "character", F.col("ep").alias("_ep"), "scene_id", written.alias("_w"))
    reach = asked.select("dataset", "character", "proposal_id", F.explode(F.sequence(F.col("ep") - F.col("reach"), "ep")).alias("_ep"))
    cited = reach.join(ids, ["dataset", "character", "_ep"]).groupBy("proposal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("scene_id", "_w"))), lambda s: s["_w"]).alias("cited"))
    asked = asked.drop("reach").join(cited, "proposal_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    return G.decided(asked, evidence, CITED_GATES).withColumn("ids", F.array_join("ids", ","))
