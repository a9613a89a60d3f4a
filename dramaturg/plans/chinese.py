"""Queries on Chinese texts and on chat entries with their target."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import chinese as Z
from dramaturg.operators import dialogue as D
from dramaturg.operators import reports as R
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT conv_id, turn, '其走了。“我说' || replace(coalesce(text, ''), '"', '') || '，我的”，其' || role || '，' || CASE turn % 3 WHEN 0 THEN '她告诉其' WHEN 1 THEN '她有自我怀疑' ELSE '我们走' END AS text FROM conversations""")
def chinese_third_person(spark, sf_dir):
    """A turn's text inside a quotation, which stays, between clauses in the first person, which don't."""
    c = read(spark, sf_dir, "conversations")
    last = F.when(F.col("turn") % 3 == 0, "她告诉我").when(F.col("turn") % 3 == 1, "她有自我怀疑").otherwise("我们走")
    told = F.concat(F.lit("我走了。“我说"), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), F.lit("，我的”，我的"), F.col("role"), F.lit("，"), last)
    return c.select("conv_id", "turn", Z.third_person(told).alias("text"))


@query("""SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 > 0 THEN '，' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '。生于' || c_nationkey ELSE '' END
  || CASE WHEN c_acctbal < 0 THEN '。性格温和' ELSE '。爱好茶' END
  || CASE WHEN c_custkey % 5 >= 3 THEN '。当前状态为情绪高兴（强度' || (c_custkey % 5) || '/10）' || CASE WHEN c_custkey % 4 = 1 THEN '，知道' || c_nationkey || '；门开了' ELSE '' END || '。'
          WHEN c_custkey % 4 = 1 THEN '。当前状态为知道' || c_nationkey || '；门开了。' ELSE '。' END AS text FROM customer""")
def chinese_tree_text(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    tree = F.struct(
        F.struct(F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("生于"), nation, F.lit("。"))).alias("backstory")).alias("identity"),
        F.create_map(
            F.lit("occupation"), F.when(k % 3 > 0, F.concat("c_mktsegment", F.lit("，"))), F.lit("personality"), F.when(F.col("c_acctbal") < 0, "温和。"), F.lit("hobbies"), F.when(F.col("c_acctbal") >= 0, "茶"),
        ).alias("persona"),
        F.struct(
            F.when(k % 4 == 1, F.array(F.concat(F.lit("知道"), nation, F.lit("。")), F.lit("门开了"))).alias("learned_info"), F.create_map().cast("map<string,string>").alias("attitude_shifts"),
            F.array().cast("array<string>").alias("commitments"), F.lit(None).cast("array<string>").alias("stance_changes"),
        ).alias("session"),
        F.struct(F.lit("高兴").alias("emotion"), (k % 5).cast("int").alias("emotion_intensity"), F.lit("").alias("scene_context")).alias("moment"),
    )
    return c.select("c_custkey", Z.tree_text(tree).alias("text"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '，猫' ELSE '' END || '，' || CASE WHEN p_size % 2 = 0 THEN p_size || '岁' ELSE '年龄约' || p_size END || '。品牌' || p_brand || '。' AS text FROM part""")
def chinese_profile_text(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    profile = F.create_map(
        F.lit("品牌"), F.col("p_brand"), F.lit("年龄"), F.when(F.col("p_size") % 2 == 0, size).otherwise(F.concat(F.lit("约"), size)), F.lit("物种"), F.when(F.col("p_size") % 3 == 0, "猫").otherwise("人类"), F.lit("备注"), F.lit("无"),
    )
    return p.select("p_partkey", Z.profile_text(F.col("p_name"), profile).alias("text"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) AS x FROM conversations),
e AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id)
SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'Mira' ELSE '用户' END || ': ' || x, chr(10) ORDER BY turn) FILTER (turn < last AND x <> '') AS context, any_value(x) FILTER (turn = last) AS target
FROM t JOIN e USING (conv_id) WHERE last IS NOT NULL GROUP BY conv_id HAVING count(*) FILTER (turn < last AND x <> '') > 0 AND any_value(x) FILTER (turn = last) <> ''""")
def chat_entry_target(spark, sf_dir):
    """Chat entries with the character's name as label, its last answer as target; entries without all parts are left out."""
    from dramaturg.functions.text import flattened

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", flattened(F.col("text")).alias("text"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    before = F.filter("m", lambda m: m["turn"] < F.col("last"))
    reference = F.element_at(F.filter("m", lambda m: m["turn"] == F.col("last")), 1)["text"]
    entry = D.chat_entry(before, F.lit("Mira"), reference)
    return turns.filter("last is not null").select("conv_id", entry.alias("e")).filter("e is not null").select("conv_id", "e.context", "e.target")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def first_documents(spark, sf_dir):
    """The first rows in a fixed order (the operator's own limit)."""
    return R.first_rows(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 25)
