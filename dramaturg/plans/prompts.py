"""Queries on the cleaning and rendering of texts; the texts come from the tables' own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import prompts as P
from dramaturg.plans.tables import EVIDENCE_SQL, evidence, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""WITH p AS (SELECT conv_id, turn, split_part(text, chr(10), 1) AS head, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN trim(rtrim(head, ' ,;')) ELSE trim(head) END AS spoken FROM p""")
def spoken_lines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    head, k = F.substring_index("text", "\n", 1), F.col("turn") % 4
    line = F.when(k == 0, '"He said."').when(k == 1, F.concat(head, F.lit(" ,; Harry noticed that all was quiet"))).when(k == 2, F.concat(F.lit("  "), head, F.lit(" "))).otherwise(head)
    return c.select("conv_id", "turn", P.spoken(line).alias("spoken"))


@query("""SELECT doc_id, CASE WHEN instr(text, ' the ') > 1 THEN trim(substr(text, 1, instr(text, ' the ') - 1)) ELSE trim(text) END AS profile FROM documents""")
def profile_before_marker(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", P.before_marker(F.col("text"), " the ").alias("profile"))


@query("""SELECT c_custkey, CASE c_name WHEN 'Customer#000000001' THEN 'First' ELSE c_name END AS name, c_custkey % 5 = 0 OR len(c_name) > 15 AS noise, c_custkey % 2 = 0 AS english,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'judge_scores.jsonl' ELSE 'judge_scores_' || regexp_replace(c_mktsegment || ' v/2', '[^\\w.-]+', '_', 'g') || '.jsonl' END AS score_file FROM customer""".replace("\\\\", "\\"))
def names_and_files(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    noted = F.when(k % 2 == 0, F.concat(F.lit(" "), "c_name", F.lit(" (aside)"))).otherwise(F.concat("c_name", F.lit("（旁白）")))
    told = F.when(k % 5 == 0, "旁白").otherwise(F.col("c_name"))
    tree_name = F.when(k % 2 == 0, F.col("c_name")).otherwise("萧峰A")
    model = F.when(F.col("c_mktsegment") == "BUILDING", "gpt-4.1").otherwise(F.concat("c_mktsegment", F.lit(" v/2")))
    return c.select(
        "c_custkey", P.plain_name(noted, {"Customer#000000001": "First"}).alias("name"), P.is_noise_name(told).alias("noise"),
        P.is_mostly_ascii(tree_name).alias("english"), P.score_file_name(model).alias("score_file"),
    )


@query("""SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Name: ' ELSE '名字: ' END || c_name, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Occupation: ' ELSE '职业: ' END || c_mktsegment END) AS summary,
  'Character: ' || c_name || chr(10) || 'Context: ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS retrieval,
  'You are ' || c_name || '.' || chr(10) || chr(10) || 'Profile: ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '(profile not available)' END || chr(10) || chr(10) || 'Scene:' || chr(10) || 'at sea' || chr(10) || c_name || ':' AS prompt FROM customer""")
def persona_prompts(spark, sf_dir):
    job = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", P.persona_summary({"occupation": job, "name": F.col("c_name")}, F.col("c_custkey") % 2 == 0).alias("summary"),
        P.retrieval_text(F.col("c_name"), job).alias("retrieval"), P.role_prompt(F.col("c_name"), F.lit("at sea"), job).alias("prompt"),
    )


@query(f"""SELECT p_partkey, list_sort(list_distinct([lower(p_name), lower(p_type) || ' (a, b)'])) AS entries, regexp_replace(trim(p_name), '([A-Za-z])$', '\\1.') AS stopped,
  '# Instruct:' || chr(10) || '{P.PROFILE_INSTRUCTION.replace("'", "''")}' || chr(10) || chr(10) || '# Character Profile:' || chr(10) || p_name AS embedded,
  CASE WHEN p_name LIKE 'p%' THEN p_name ELSE 'part: ' || p_name END AS prefixed FROM part""")
def entries_and_templates(spark, sf_dir):
    listed = F.concat(F.upper("p_name"), F.lit(" ,  "), F.regexp_replace("p_type", " ", "   "), F.lit("  (a, b),, "), "p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", P.normal_entries(listed).alias("entries"), P.full_stop(F.col("p_name")).alias("stopped"), P.embedding_prompt(F.concat(F.lit(" "), "p_name")).alias("embedded"),
        P.prefixed("part: ", F.concat("p_name", F.lit("。， ")), ["p"]).alias("prefixed"),
    )


@query("""WITH u AS (SELECT conv_id, turn, role || ': ' || split_part(text, chr(10), 1) AS line FROM conversations WHERE turn < 3)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS scene FROM u GROUP BY conv_id""")
def scene_rendering(spark, sf_dir):
    said = F.struct("turn", F.col("role").alias("speaker"), F.substring_index("text", "\n", 1).alias("text"))
    scenes = read(spark, sf_dir, "conversations").filter("turn < 8").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("u"))
    return scenes.select("conv_id", P.scene_text(F.col("u"), 3).alias("scene"))


@query("""SELECT p_partkey, [p_brand, 'calm quiet', lower(p_type)] AS phrases, p_brand || ', calm quiet, ' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '.' ELSE '' END AS rejoined FROM part""")
def descriptor_lists(spark, sf_dir):
    value = F.concat("p_brand", F.lit(", calm and quiet, , "), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, ". ").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", P.descriptors(value).alias("phrases"), P.joined_descriptors(P.descriptors(value), value).alias("rejoined"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS learned, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'neutral' END AS emotion,
  CAST(CASE WHEN p_size = 5 THEN 3 ELSE least(10, greatest(1, p_size - 5)) END AS INT) AS intensity, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS job FROM part""")
def coerced_updates(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    learned = F.when(F.col("p_size") % 3 == 0, '""').otherwise(F.concat(F.lit('"'), "p_brand", F.lit('", ""')))
    emotion = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise("null")
    text = F.concat(F.lit('{"session": {"learned_info": ['), learned, F.lit(']}, "moment": {"emotion": '), emotion, F.lit(', "emotion_intensity": '), (F.col("p_size") - 5).cast("string"), F.lit("}}"))
    tree = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"persona": {"job": {"value": "'), "p_brand", F.lit('", "update_count": 1}}}'))).otherwise(
        F.concat(F.lit('{"persona": {"job": '), F.col("p_size").cast("string"), F.lit("}}"))
    )
    made = p.select("p_partkey", P.coerced_update(text).alias("u"), P.field_value(tree, "job").alias("job"))
    return made.select("p_partkey", F.size("u.learned_info").alias("learned"), "u.emotion", F.col("u.emotion_intensity").alias("intensity"), "job")


@query(f"""WITH {EVIDENCE_SQL} SELECT "character", string_agg('- [E' || ep || ', session_id=' || event_id || ', sig=high] ' || event_type, chr(10) ORDER BY ep, event_id) AS archive FROM ev WHERE significance = 'high' GROUP BY 1""")
def archive_rendering(spark, sf_dir):
    high = evidence(spark, sf_dir).filter("significance = 'high'")
    line = P.archive_line(F.concat(F.lit("E"), F.col("ep").cast("string")), F.col("event_id").cast("string"), F.col("significance"), F.col("event_type"))
    told = high.groupBy("character").agg(F.sort_array(F.collect_list(F.struct("ep", "event_id", line.alias("line")))).alias("lines"))
    return told.select("character", F.array_join("lines.line", "\n").alias("archive"))


@query(f"""WITH {EVIDENCE_SQL}, u AS (SELECT "character", count(*) FILTER (event_type = 'click') AS n, max(ep) FILTER (event_type = 'click') AS surface, max(ep) FILTER (event_type = 'signup' AND significance = 'high') AS deep FROM ev GROUP BY 1)
SELECT "character", n >= 3 AND (deep IS NULL OR surface > deep) AS drifting FROM u""")
def drift_trigger(spark, sf_dir):
    kind = F.col("event_type")
    u = evidence(spark, sf_dir).groupBy("character").agg(
        F.count_if(kind == "click").alias("n"), F.max(F.when(kind == "click", F.col("ep"))).alias("surface"), F.max(F.when((kind == "signup") & (F.col("significance") == "high"), F.col("ep"))).alias("deep")
    )
    return u.select("character", P.drifting(F.col("n"), F.col("surface"), F.col("deep")).alias("drifting"))
