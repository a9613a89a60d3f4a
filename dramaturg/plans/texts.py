"""Queries on model answers, relationships, trees and files, over data that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dramaturg.functions import narration as N
from dramaturg.functions import text as T
from dramaturg.operators import profiles as P
from dramaturg.plans.tables import read
from dramaturg.sources import files
from dramaturg.sources.scratch import scratch_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality * 4 + 1 END AS INT) AS character_score, CAST(CASE WHEN doc_id % 5 = 4 THEN NULL ELSE toxic + 2 END AS INT) AS semantic_score FROM labels""")
def judge_response_parse(spark, sf_dir):
    """Answers in the ways judges write them: plain, fenced, with a trailing comma, loose, or none."""
    q, t = (F.col("quality") * 4 + 1).cast("string"), (F.col("toxic") + 2).cast("string")
    plain = F.concat(F.lit('{"character_score": '), q, F.lit(', "semantic_score": '), t, F.lit("}"))
    way = F.col("doc_id") % 5
    answer = (
        F.when(way == 0, plain)
        .when(way == 1, F.concat(F.lit("Sure!\n```json\n"), plain, F.lit("\n```")))
        .when(way == 2, F.concat(F.lit('I think {"character_score": '), q, F.lit(', "semantic_score": '), t, F.lit(",}")))
        .when(way == 3, F.concat(F.lit("character_score: "), q, F.lit(" and semantic_score = "), t))
        .otherwise("no idea")
    )
    rows = read(spark, sf_dir, "labels").select("doc_id", answer.alias("answer"))
    return rows.select("doc_id", *[T.judged(F.col("answer"), f).alias(f) for f in ("character_score", "semantic_score")])


def _relationships(spark, sf_dir):
    """One text a supplier: the parts' brands and types it sells, as people and roles."""
    l = read(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_suppkey", "l_partkey").distinct()  # noqa: E741
    role = F.element_at(F.array(*map(F.lit, ["friends", "sister", "engaged to", "ex-wife", "colleague"])), (F.col("l_partkey") % 5 + 1).cast("int"))
    entry = F.concat(role, F.lit(" is P"), F.col("l_partkey") % 7, F.lit(" (met, once)"))
    return l.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set(entry)), ", ").alias("text"))


_ENTRIES = """x AS (SELECT DISTINCT l_suppkey, ['friends', 'sister', 'engaged to', 'ex-wife', 'colleague'][l_partkey % 5 + 1] AS role, 'P' || (l_partkey % 7) AS name FROM lineitem WHERE l_quantity >= 49),
e AS (SELECT l_suppkey, role, name, row_number() OVER (PARTITION BY l_suppkey ORDER BY role || ' is ' || name) - 1 AS place FROM x)"""


@query(f"WITH {_ENTRIES} SELECT l_suppkey, CAST(place AS INT) AS place, role, name, role || ' is ' || name || ' (met, once)' AS raw FROM e")
def relationship_parse(spark, sf_dir):
    return P.edges(_relationships(spark, sf_dir), "l_suppkey", "text")


@query(f"""WITH {_ENTRIES}, n AS (SELECT l_suppkey, place, name, CASE role WHEN 'friends' THEN 'friend' WHEN 'engaged to' THEN 'fiancé' ELSE role END AS role FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, name ORDER BY CASE role WHEN 'ex-wife' THEN 0 WHEN 'fiancé' THEN 4 WHEN 'sister' THEN 7 WHEN 'friend' THEN 11 ELSE 12 END, place) AS k FROM n)
SELECT l_suppkey, string_agg(role || ' is ' || name, ', ' ORDER BY place) AS relationships FROM r WHERE k = 1 GROUP BY l_suppkey""")
def relationship_dedupe(spark, sf_dir):
    edges = P.edges(_relationships(spark, sf_dir), "l_suppkey", "text")
    return P.rendered(P.strongest(edges.withColumn("role", P.legacy_role(F.col("role"))), "l_suppkey"), "l_suppkey")


def _trees(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    persona = F.create_map(F.lit("job"), F.lower("c_mktsegment"), F.lit("mood"), F.when(F.col("c_acctbal") < 0, "bitter").otherwise("calm"))
    learned = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("the code"), F.lit("the door"))).otherwise(F.array().cast("array<string>"))
    gender = F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male")
    emotion = F.when(F.col("c_custkey") % 4 == 0, "neutral").otherwise("joy")
    return c.select("c_custkey", P.tree(F.col("c_custkey").cast("string"), F.col("c_name"), gender, persona, learned, emotion, (F.col("c_custkey") % 15).cast("int")).alias("tree"))


@query("""SELECT c_custkey, c_name || ' (' || CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END || '). job: ' || lower(c_mktsegment) || '; mood: ' || CASE WHEN c_acctbal < 0 THEN 'bitter' ELSE 'calm' END
  || CASE WHEN c_custkey % 3 = 0 THEN '. Knows the code, the door' ELSE '' END || CASE WHEN c_custkey % 4 <> 0 AND greatest(1, least(10, c_custkey % 15)) >= 3 THEN '. Feels joy' ELSE '' END AS text FROM customer""")
def tree_to_text(spark, sf_dir):
    return _trees(spark, sf_dir).select("c_custkey", P.tree_text(F.col("tree")).alias("text"))


@query("SELECT c_custkey, c_name || ' (' || CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END || '). job: sailor; mood: ' || CASE WHEN c_acctbal < 0 THEN 'bitter' ELSE 'calm' END AS text, 1 AS updates FROM customer")
def layer_update(spark, sf_dir):
    tree = F.col("tree")
    changed = tree.withField("persona", P.updated(tree["persona"], "job", F.lit("sailor"), F.lit("S01E02")))
    return _trees(spark, sf_dir).select("c_custkey", P.tree_text(P.cleared(changed)).alias("text"), changed["persona"]["job"]["update_count"].alias("updates"))


@query("""SELECT conv_id, turn, 'Well, ' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 4) || '.' AS speech, 'He is ' || role || '. Then he met his friend.' AS profile FROM conversations""")
def narration_and_perspective(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    told = F.concat(F.lit('"Well," she said, "'), F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 4), F.lit('." he replied softly'))
    first = F.concat(F.lit("I am "), F.col("role"), F.lit(". Then I met my friend."))
    return c.select("conv_id", "turn", N.clean_narration(told).alias("speech"), N.third_person(first, F.lit("male")).alias("profile"))


@query("""SELECT conv_id, turn, role AS speaker, 'a: b' AS speech, CAST(turn + 1 AS INT) AS chapter, 'p' || printf('%02d', turn + 1) AS version, role = 'user' AS couple FROM conversations""")
def line_and_position_parse(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    line = F.concat(F.col("role"), F.lit(":  a: b "))
    position = F.concat(F.lit("Book3-chapter"), F.col("turn") + 1)
    text = F.concat(F.lit("It rained. Ann and Bob "), F.when(F.col("role") == "user", "married").otherwise("sang"), F.lit(" in May."))
    return c.select(
        "conv_id", "turn", T.speaker_of(line).alias("speaker"), T.speech_of(line).alias("speech"), T.position_number(position, "chapter").alias("chapter"),
        T.next_version(F.format_string("p%02d", F.col("turn"))).alias("version"), N.pair_event(text, F.lit("Ann"), F.lit("Bob"), ["married", "engaged"]).alias("couple"),
    )


@query("SELECT quality AS split, count(*) AS n, sum(doc_id) AS total FROM labels GROUP BY quality")
def json_round_trip(spark, sf_dir):
    """Labels written as JSON lines in a folder a split, and read back tolerantly."""
    place = f"{scratch_dir(spark)}/json-{uuid.uuid4().hex}"
    files.write_splits(read(spark, sf_dir, "labels").withColumnRenamed("quality", "split").withColumn("_private", F.lit(1)), place)
    back = files.json_lines(spark, place, "doc_id bigint, toxic int, split int", strict=False)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


@query("SELECT l_orderkey, max(l_linestatus) AS split FROM lineitem GROUP BY 1")
def split_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("split"))
    return files.merge_splits(rows, "l_orderkey", "split", ["F", "O"])
