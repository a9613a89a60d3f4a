"""Queries from turns to samples, splits and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from dramaturg.functions import text as T
from dramaturg.operators import dialogue as D
from dramaturg.operators import evaluate as E
from dramaturg.plans.tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FLAT = r"trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'))"


@query(rf"""
WITH t AS (SELECT conv_id, turn, role, {_FLAT} AS text FROM conversations),
c AS (SELECT *, string_agg(CASE WHEN text <> '' THEN role || ': ' || text END, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM t)
SELECT 'S_' || left(md5(conv_id || '_' || turn), 12) AS question_id, role, context AS input, text AS output
FROM c WHERE role IN ('user', 'assistant') AND turn >= 3 AND context <> '' AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 3
""")
def next_utterance_samples(spark, sf_dir):
    return D.next_utterance_samples(read(spark, sf_dir, "conversations"), ["user", "assistant"])


@query(rf"""
WITH t AS (SELECT conv_id, turn, role, {_FLAT} AS text, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
c AS (SELECT *, string_agg(CASE WHEN text <> '' THEN role || ': ' || text END, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM t)
SELECT conv_id, turn, context AS input, text AS output FROM c WHERE turn = last AND context <> ''
""")
def last_target_sample(spark, sf_dir):
    return D.last_target_samples(read(spark, sf_dir, "conversations"), "assistant")


_SPLIT_SQL = """s AS (SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'ood_test'
  WHEN CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'random_test' ELSE 'train' END AS split FROM events)"""


def _split(spark, sf_dir):
    return D.split(read(spark, sf_dir, "events"), "ts", F.lit("2024-01-25").cast("timestamp"), "event_id")


@query(f"WITH {_SPLIT_SQL} SELECT event_id, split FROM s")
def split_temporal_and_hash(spark, sf_dir):
    return _split(spark, sf_dir).select("event_id", "split")


@query(f"WITH {_SPLIT_SQL} SELECT split, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY split")
def split_coverage(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {_SPLIT_SQL}, d AS (SELECT DISTINCT user_id, split FROM s)
SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared_keys FROM d a JOIN d b ON a.user_id = b.user_id AND a.split < b.split GROUP BY 1, 2""")
def split_disjointness(spark, sf_dir):
    return D.split_overlaps(_split(spark, sf_dir), "user_id")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')")
def missing_characters(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("split", F.when(F.col("ts") >= "2024-01-30", "late").otherwise("early"))
    return D.missing_from(e, "user_id", "split", "late")


@query("SELECT d.doc_id, d.source, coalesce(CASE WHEN l.quality = 1 THEN 'good' ELSE CASE WHEN l.quality = 0 THEN 'poor' END END, '') AS profile, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def profile_injection_left(spark, sf_dir):
    profiles = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("profile"))
    return E.attach_left(read(spark, sf_dir, "documents").select("doc_id", "source"), profiles, "doc_id", "profile")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowlist_semi_join(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query(r"""WITH f AS (SELECT conv_id, string_agg(x, chr(10) ORDER BY turn) AS context FROM (
  SELECT conv_id, turn, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) <> '') WHERE r <= 2 GROUP BY conv_id)
SELECT left(sha1(context), 16) AS fingerprint, count(*) AS scenes, min(conv_id) AS first_scene FROM f GROUP BY 1""")
def scene_fingerprint_groups(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("text", T.flattened(F.col("text"))).filter("text <> ''")
    lines = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s.text), "\n").alias("context"))
    return lines.groupBy(D.scene_fingerprint(F.col("context")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("scenes"), F.min("conv_id").alias("first_scene"))


@query("""SELECT conv_id, len(list_filter(list(role ORDER BY turn), lambda r: r = 'assistant')) AS answers,
  string_agg(CASE role WHEN 'assistant' THEN 'NPC' ELSE 'User' END, '>' ORDER BY turn) AS speakers FROM conversations GROUP BY conv_id""")
def chat_entry_sample(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"))
    label = F.transform("m", lambda m: F.when(m.role == "assistant", "NPC").otherwise("User"))
    return turns.select("conv_id", F.size(F.filter("m", lambda m: m.role == "assistant")).alias("answers"), F.array_join(label, ">").alias("speakers"))


@query(r"""SELECT doc_id, regexp_replace(left(text, 300), '\s*\n\s*', ' ', 'g') AS flat FROM documents WHERE false
UNION ALL SELECT doc_id, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) FROM documents""")
def flattened_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.flattened(F.col("text")).alias("flat"))


@query(r"""WITH t AS (SELECT doc_id, source, text FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM t""")
def text_cleaners(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.without_parentheses(F.col("text")).alias("plain"), T.slug(F.col("source")).alias("slug"))


@query("""WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]')) / nullif(length(text), 0) AS s FROM documents)
SELECT doc_id, round(s, 6) AS share, CASE WHEN s > 0.5 THEN 'en' ELSE 'zh' END AS lang FROM r""")
def ascii_ratio_language(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.ascii_letter_share(t), 6).alias("share"), T.entry_language(t).alias("lang"))


@query("""SELECT source, round(sum(len(regexp_extract_all(text, '[a-zA-Z]'))) / sum(length(text)), 6) AS share,
  sum(len(regexp_extract_all(text, '[a-zA-Z]'))) / sum(length(text)) > 0.5 AS english FROM documents GROUP BY source""")
def character_language(spark, sf_dir):
    share = F.sum(F.regexp_count("text", F.lit("[a-zA-Z]"))) / F.sum(F.length("text"))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.round(share, 6).alias("share"), (share > 0.5).alias("english"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS d FROM documents)
SELECT doc_id, coalesce(len(regexp_extract_all(d, '[一-鿿]')) / nullif(length(d), 0) > 0.3, true) AS chinese FROM r""")
def cjk_ratio_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.is_chinese(F.col("text")).alias("chinese"))


@query(r"""WITH w AS (SELECT doc_id, source, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda x: x NOT IN ('the', 'and', 'that', 'with')) AS ws,
  lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents)
SELECT b.doc_id, round(CASE WHEN len(a.ws) = 0 THEN 1.0 ELSE len(list_intersect(a.ws, b.ws)) / len(a.ws) END, 6) AS recall FROM w b JOIN w a ON a.doc_id = b.prev""")
def word_recall(spark, sf_dir):
    from pyspark.sql.window import Window

    d = read(spark, sf_dir, "documents")
    old = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    return d.withColumn("old", old).filter("old is not null").select("doc_id", F.round(T.word_recall(F.col("old"), F.col("text"), ["the", "and", "that", "with"]), 6).alias("recall"))


@query("""WITH h AS (SELECT source, doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place FROM h) WHERE place <= 8""")
def stratified_sample(spark, sf_dir):
    from dramaturg.operators.sampling import stratified

    return stratified(read(spark, sf_dir, "documents"), "source", "doc_id", 8).select("source", "doc_id", "place")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT *, n * 97 / sum(n) OVER () AS share FROM c),
f AS (SELECT *, greatest(floor(share), 1) AS fl, share - floor(share) AS rest FROM s),
p AS (SELECT *, 97 - sum(fl) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, source) AS place FROM f)
SELECT source, n, CAST(least(n, fl + CASE WHEN place <= spare THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM p""")
def proportional_downsample(spark, sf_dir):
    from dramaturg.operators.sampling import proportional_quotas

    counts = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return proportional_quotas(counts, "source", "n", 97)


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
w AS (SELECT lang, 1.0::DOUBLE AS uniform, n::DOUBLE AS size, sqrt(n) AS root, 1.0 / n AS inverse FROM c),
r AS (SELECT lang, round(greatest(uniform, 0.1 * max(uniform) OVER ()), 9) AS uniform, round(greatest(size, 0.1 * max(size) OVER ()), 9) AS size,
  round(greatest(root, 0.1 * max(root) OVER ()), 9) AS root, round(greatest(inverse::DOUBLE, 0.1 * max(inverse::DOUBLE) OVER ()), 9) AS inverse FROM w)
SELECT lang, round(uniform / sum(uniform) OVER (), 6) AS uniform, round(size / sum(size) OVER (), 6) AS size, round(root / sum(root) OVER (), 6) AS root, round(inverse / sum(inverse) OVER (), 6) AS inverse FROM r""")
def mixture_weights(spark, sf_dir):
    from dramaturg.operators.sampling import mixture_weights as weights

    return weights(read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n")


@query("SELECT doc_id, CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 4 AS INT) AS shard FROM documents")
def round_robin_shards(spark, sf_dir):
    from dramaturg.operators.sampling import round_robin

    return round_robin(read(spark, sf_dir, "documents"), "doc_id", 4).select("doc_id", "shard")
