"""Queries on parsers, corrections of states, audits and assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import parsers as P
from dramaturg.operators import checks as C
from dramaturg.operators import dialogue as D
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, printf('s%02d_e%02d_c%02d', CAST(month(ts) AS INT), CAST(day(ts) AS INT), CAST(hour(ts) AS INT)) AS scene_id FROM events")
def scene_id_canonical(spark, sf_dir):
    told = F.format_string("S%dE%d_c%d", F.month("ts"), F.dayofmonth("ts"), F.hour("ts"))
    return read(spark, sf_dir, "events").select("event_id", P.scene_id(told).alias("scene_id"))


@query("SELECT c_custkey, c_name AS name, lower(c_mktsegment) || ' on ships' AS job, 2 AS keys FROM customer")
def key_value_blocks(spark, sf_dir):
    text = F.concat(F.lit("Name: "), F.col("c_name"), F.lit("\nJob： "), F.lower("c_mktsegment"), F.lit("\n  on ships\nName: other"))
    kv = P.key_values(text)
    return read(spark, sf_dir, "customer").select("c_custkey", kv["Name"].alias("name"), kv["Job"].alias("job"), F.size(kv).alias("keys"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (turn % 2 = 1) AS thoughts, min(role) AS first_speaker FROM conversations GROUP BY conv_id")
def turn_parser(spark, sf_dir):
    said = F.concat(F.col("role"), F.when(F.col("turn") % 2 == 1, " (thinking): hm").otherwise(" (speaking): hello\nyou"))
    whole = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.array_join(F.collect_list(said), "<|eot|>"), F.lit("<|eot|>junk")).alias("text"))
    t = whole.select("conv_id", P.turns(F.col("text")).alias("t"))
    return t.select(
        "conv_id", F.size("t").alias("turns"), F.size(F.filter("t", lambda x: x.action == "thinking")).alias("thoughts"), F.array_min(F.transform("t", lambda x: x.speaker)).alias("first_speaker")
    )


@query("SELECT c_custkey, c_name AS name, CAST(20 + c_custkey % 60 AS INT) AS age, CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS gender FROM customer")
def demographics(spark, sf_dir):
    k = F.col("c_custkey")
    years = (20 + k % 60).cast("string")
    told = F.when(k % 2 == 0, F.concat(F.lit("a "), years, F.lit("-year-old "))).otherwise(F.concat(F.lit("age: "), years, F.lit(" ")))
    text = F.concat(F.lit("You are "), F.col("c_name"), F.lit(", "), told, F.when(k % 3 == 0, "woman").when(k % 3 == 1, "man").otherwise("person"))
    return read(spark, sf_dir, "customer").select("c_custkey", P.protagonist(text).alias("name"), P.age(text).alias("age"), P.gender(text).alias("gender"))


@query("""SELECT sha256(text)[1:16] AS profile_key, count(*) AS samples, min(doc_id) AS first_sample FROM documents GROUP BY text""")
def unique_profiles(spark, sf_dir):
    key = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)
    return read(spark, sf_dir, "documents").groupBy(key.alias("profile_key")).agg(F.count(F.lit(1)).alias("samples"), F.min("doc_id").alias("first_sample"))


@query("""WITH g AS (SELECT conv_id, turn, role, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id, CAST(min(turn) AS BIGINT) AS turn, string_agg(CASE WHEN turn % 3 = 0 THEN role || ': x' ELSE 'and y' END, ' ' ORDER BY turn) AS line FROM g GROUP BY conv_id, g""")
def continuation_merge(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit(": x"))).otherwise("and y").alias("line"))
    return D.merged_continuations(lines, "conv_id", "turn", "line")


_ENT = "SELECT DISTINCT l_suppkey AS owner, l_partkey % 50 AS name, CASE l_partkey % 50 % 3 WHEN 0 THEN 'sister' ELSE 'wife' END AS role FROM lineitem"


def _entries(spark, sf_dir, where):
    l = read(spark, sf_dir, "lineitem").filter(where)  # noqa: E741
    role = F.when(F.col("l_partkey") % 50 % 3 == 0, "sister").otherwise("wife")
    return l.select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 50).alias("name"), role.alias("role")).distinct()


@query(f"""WITH b AS ({_ENT} WHERE l_linenumber = 1), a AS ({_ENT} WHERE l_linenumber = 2), x AS ({_ENT} WHERE l_quantity = 50)
SELECT owner, name, role FROM b WHERE (owner, name) NOT IN (SELECT (owner, name) FROM a) AND (role = 'sister' OR (owner, name) NOT IN (SELECT (owner, name) FROM x))""")
def lost_roles_restored(spark, sf_dir):
    return C.lost_roles(_entries(spark, sf_dir, "l_linenumber = 1"), _entries(spark, sf_dir, "l_linenumber = 2"), _entries(spark, sf_dir, "l_quantity = 50"), ["sister"])


_CLAIM = "cl AS (SELECT DISTINCT l_suppkey % 40 AS owner, l_partkey % 40 AS name, CAST(l_linenumber AS INT) AS ep FROM lineitem WHERE l_quantity >= 49)"


@query(f"WITH {_CLAIM} SELECT * FROM cl c WHERE NOT EXISTS (SELECT 1 FROM cl o WHERE o.owner = c.name AND o.name = c.owner AND abs(o.ep - c.ep) <= 1)")
def uncorroborated_claims(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter("l_quantity >= 49")  # noqa: E741
    claims = l.select((F.col("l_suppkey") % 40).alias("owner"), (F.col("l_partkey") % 40).alias("name"), F.col("l_linenumber").cast("int").alias("ep")).distinct()
    return C.uncorroborated(claims, 1)


@query("""WITH v AS (SELECT user_id % 30 AS owner, CAST(json_extract(props, '$.k') AS INT) AS partner, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT *, first(owner) OVER (PARTITION BY partner ORDER BY n DESC, owner) AS true_owner FROM v) SELECT owner, partner, n, true_owner FROM t WHERE owner <> true_owner""")
def borrowed_partners(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("owner"), F.get_json_object("props", "$.k").cast("int").alias("partner"))
    return C.borrowed_partners(e.groupBy("owner", "partner").agg(F.count(F.lit(1)).alias("n")))


@query("""WITH p AS (SELECT event_id AS proposal, user_id AS "character", CAST(day(ts) // 3 AS INT) AS checkpoint, event_type || event_id AS field, repeat('v', CAST(event_id % 100 AS INT)) AS new_value, CAST(event_id % 5 AS INT) AS cited FROM events),
v AS (SELECT *, cited >= 2 AND length(new_value) <= 80 AND trim(new_value) <> '' AS ok FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY "character", checkpoint ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, cited DESC, field) AS r FROM v),
b AS (SELECT *, max(CASE WHEN ok AND r = 1 THEN checkpoint END) OVER (PARTITION BY "character" ORDER BY checkpoint RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT proposal, CASE WHEN NOT ok THEN 'invalid' WHEN r > 1 THEN 'second' WHEN checkpoint - before <= 2 THEN 'cooldown' ELSE 'applied' END AS decision FROM b""")
def core_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("proposal"), F.col("user_id").alias("character"), F.floor(F.dayofmonth("ts") / 3).cast("int").alias("checkpoint"), F.concat("event_type", "event_id").alias("field"),
        F.expr("repeat('v', cast(event_id % 100 as int))").alias("new_value"), (F.col("event_id") % 5).cast("int").alias("cited"),
    )
    return C.audited(e).select("proposal", "decision")


_DAYS = "dl AS (SELECT user_id, CAST(day(ts) AS INT) AS ep, max(event_type) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {_DAYS}, b AS (SELECT *, max(CASE WHEN ep = 10 THEN v END) OVER (PARTITION BY user_id) AS base FROM dl),
d AS (SELECT *, min(CASE WHEN ep > 10 AND v IS DISTINCT FROM base THEN ep END) OVER (PARTITION BY user_id) AS stop FROM b)
SELECT user_id, ep, CASE WHEN ep >= 10 AND (stop IS NULL OR ep < stop) AND base IS NOT NULL THEN 'changed' ELSE v END AS forwarded FROM d""")
def forward_propagation(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("ep")).agg(F.max("event_type").alias("v"))
    return C.forwarded(days, "user_id", "ep", "v", 10, "changed").select("user_id", "ep", "forwarded")


@query("""WITH r AS (SELECT doc_id, 'R1' AS rater FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'R2' FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'R3' FROM labels)
SELECT doc_id, string_agg(rater, ',' ORDER BY rater) AS raters FROM r GROUP BY doc_id HAVING count(*) < 3""")
def rater_mismatch(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return C.rater_mismatch({"R1": l.filter("doc_id % 7 <> 0"), "R2": l.filter("doc_id % 5 <> 0"), "R3": l}, "doc_id")


@query("""WITH m AS (SELECT user_id, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events),
s AS (SELECT *, r - max(CASE WHEN loss = best THEN r END) OVER (PARTITION BY user_id ORDER BY step) AS since FROM m),
t AS (SELECT *, max(since) OVER (PARTITION BY user_id ORDER BY step) >= 5 AS stopped FROM s)
SELECT user_id, arg_min(step, (loss, step)) AS best_step, min(loss) AS best_loss FROM t WHERE NOT stopped GROUP BY user_id""")
def best_checkpoint(spark, sf_dir):
    return C.best_checkpoint(read(spark, sf_dir, "events"), "user_id", "event_id", "value", 5)


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS partners, count(DISTINCT event_type) AS n FROM events WHERE value >= 200 GROUP BY user_id""")
def distinct_partners(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("value >= 200").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("p"))
    return e.select("user_id", F.array_join("p", ",").alias("partners"), F.size("p").alias("n"))
