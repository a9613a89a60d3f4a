"""Line deduplication by an exact set-similarity join (operator 10), DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, dropped, fresh, replaced, table, tidy_shuffles, written

_LAST = 2**63 - 1
#: Classes of frequency: a token is in class c if it holds at least one of 2**_SHARES[c] of all
#: occurrences, so that a class lists at most 2**_SHARES[c] tokens. The other tokens are the rarest.
_SHARES = (17, 15, 13, 11)
#: Lines with the same three tokens at an end of their order of hashes from which on they may be a family of near copies.
_CROWD = 8
#: Lines with one prefix token from which on they meet by pairs of tokens only; so an entry of the index meets a bounded number of others by a token.
_DENSE = 4096
#: Rows (a few longs each) that a broadcast may have.
_NAMED = 500_000
#: Lines of more tokens carry a second bitmap.
_LONG = 80
#: Of tables whose longs are hashes: dictionaries of them cost more than they save.
_HASHES = {"parquet.block.size": str(2 << 20), "parquet.enable.dictionary": "false", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def line_tokens(line: Column) -> Column:
    """Sorted 64-bit hashes of the distinct lower-case tokens of a line (white space: see :func:`_plain`)."""
    hashed = F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.sort_array(F.array_distinct(hashed)), F.xxhash64(F.lit("")))


def _plain(text: Column) -> Column:
    """The text with every white space but the line feed as a space; texts without any are only searched once."""
    plain = text
    for sign in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(sign), F.lit(" "))
    return F.when(text.rlike(r"[\t\x0B\f\r]"), plain).otherwise(text)


def _frequent(lines: DataFrame) -> tuple[list[list[int]], DataFrame]:
    """The tokens of each class of frequency, the largest class first, and all of ``_DENSE`` lines or more.

    All tokens of all ``lines`` are counted. The classes are bounded; the tokens of many lines stay a table.
    """
    total = lines.agg(F.sum("n").alias("n")).first()["n"] or 0
    counts = lines.select(F.explode("tokens").alias("token")).groupBy("token").count()
    large = F.col("count") * (1 << _SHARES[0]) >= total
    counts = cut(counts.filter((F.col("count") > 1) & (large | (F.col("count") >= _DENSE))))
    often = counts.filter(large).collect()
    return [sorted(r["token"] for r in often if r["count"] << share >= total) for share in _SHARES], counts.filter(F.col("count") >= _DENSE).select("token")


def _prefix_length(percent: int) -> Column:
    """Of so many tokens of a line, in order of rarity, every similar line has one among its own."""
    return F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1


def _shared_prefix(least: Column, percent: int) -> Column:
    """As :func:`_prefix_length`, of those similar lines only that have ``least`` tokens or more: sets of n and m tokens share t / (1 + t) (n + m) of them."""
    return F.col("n") - F.ceil((F.col("n") + least) * percent / (100 + percent)).cast("int") + 1


def _size_class(n: Column, percent: int) -> Column:
    """Sizes by powers of 1 / t: those of similar lines are in one class or in two next to each other."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent))).cast("int") if percent < 100 else n


def _with_prefix(lines: DataFrame, frequent: list[list[int]], percent: int) -> DataFrame:
    """``lines`` with ``prefix``: the first tokens of each line in order of rarity, and one more.

    Tokens in no class come first, then those of each class that aren't in the next one. Inside a
    class the order is that of hashes, in which ``tokens`` are already. Only lines that are short
    of rarer tokens look for frequent ones, and only among the tokens left, class by class.
    """
    length = _prefix_length(percent) + 1
    frequent = [f for f in frequent if f]
    if not frequent:
        return lines.withColumn("prefix", F.slice("tokens", F.lit(1), length))
    parted = lines.withColumns({"left": F.col("tokens"), "ordered": F.array().cast("array<bigint>")})
    for f in frequent:
        # as text: a column for each of some ten thousand literals would take the driver seconds
        rarer = F.expr(f"filter(left, t -> NOT t IN ({', '.join(f'{t}L' for t in f)}))")
        parted = parted.withColumn("rarer", F.when(F.size("ordered") < length, rarer))
        parted = parted.withColumn("ordered", F.when(F.col("rarer").isNull(), F.col("ordered")).otherwise(F.concat("ordered", "rarer")))
        parted = parted.withColumn("left", F.when(F.size("ordered") < length, F.array_except("left", "rarer")))
    ordered = F.when(F.col("left").isNull(), F.col("ordered")).otherwise(F.concat("ordered", "left"))
    return parted.withColumn("prefix", F.slice(ordered, F.lit(1), length)).drop("left", "ordered", "rarer")


def _bitmaps() -> list[Column]:
    """``b``: 64 bits of ``tokens``, each token flips the bit that its low six bits name; ``c``: of long lines, those whose bit 6 is set."""
    flip = "a ^ shiftleft(1L, cast(t & 63 as int))"
    second = F.expr(f"aggregate(tokens, 0L, (a, t) -> if((t & 64) = 64, {flip}, a))")
    return [F.expr(f"aggregate(tokens, 0L, (a, t) -> {flip})").alias("b"), F.when(F.col("n") > _LONG, second).otherwise(F.lit(0)).alias("c")]


def _joined(x: DataFrame, y: DataFrame, percent: int, by_size: bool) -> DataFrame:
    """Distinct pairs of lines (``xk, xt`` and ``yk, yt``, the earlier one first) that share a ``token`` and pass all filters; none whose later line is settled.

    Length and positional filter: of the tokens before the shared one at most min(i, j) are shared,
    and after it at most as many as the shorter rest has; that must be enough. Bitmap filter: sets
    of similarity t differ in at most (1 - t) / (1 + t) (n + m) tokens, and each bit in which two
    bitmaps differ is due to a token of its own that only one set has. Bitmaps of two long lines
    are compared by halves. ``by_size``: x is the smaller line, or the
    earlier one of two equal sizes.
    """
    names = ["k", "t", "m", "b", "c"]
    x, y = x.select("token", *[F.col(c).alias(f"x_{c}") for c in names]), y.select("token", *[F.col(c).alias(f"y_{c}") for c in names])
    place = lambda side: F.shiftright(F.col(f"{side}_m").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    n, m = F.shiftright("x_m", 32), F.shiftright("y_m", 32)
    i, j = place("x"), place("y")
    # the order of the tests is that of their cost and power
    earlier = (F.col("x_k") < F.col("y_k")) | ((F.col("x_k") == F.col("y_k")) & (F.col("x_t") < F.col("y_t")))
    other = (F.col("x_k") != F.col("y_k")) | (F.col("x_t") != F.col("y_t"))
    open_ = F.when(earlier, F.col("y_m")).otherwise(F.col("x_m")).bitwiseAND(F.lit(1)) == 1
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    could = (F.least(i, j) + F.least(n - i, m - j)) * (100 + percent) >= (n + m) * percent
    whole, second = F.col("x_b").bitwiseXOR(F.col("y_b")), F.col("x_c").bitwiseXOR(F.col("y_c"))
    few = lambda bits: bits * (100 + percent) <= (n + m) * (100 - percent)
    halves = (n <= _LONG) | (m <= _LONG) | few(F.bit_count(second) + F.bit_count(whole.bitwiseXOR(second)))
    once = (n < m) | ((n == m) & earlier) if by_size else other
    # both sides are dealt by token, of which none has many lines: tables of them need no sort
    pairs = (x.hint("shuffle_hash") if by_size else x).join(y, "token").filter(fits & few(F.bit_count(whole)) & could & once & open_ & halves)
    swap = lambda a, b: F.when(earlier, F.col(a)).otherwise(F.col(b))
    return pairs.select(swap("x_k", "y_k").alias("xk"), swap("x_t", "y_t").alias("xt"), swap("y_k", "x_k").alias("yk"), swap("y_t", "x_t").alias("yt")).distinct()


def _named(named: DataFrame) -> DataFrame:
    """``named`` for a join: broadcast if it is small enough (rows of a few longs), else shuffled."""
    named = cut(named)
    return F.broadcast(named) if named.count() <= _NAMED else named


def _first_lines(lines: DataFrame) -> DataFrame:
    """Of lines with equal token sets the first one only, as it is.

    Most sets have one line. Those of more are found and named by a few longs, so that lists of tokens are neither sorted nor shuffled.
    """
    sets = ["s0", "s1", "n"]
    narrow = lines.select(*sets, "key", "at", "row")
    copied = _named(narrow.groupBy(*sets).agg(F.count(F.lit(1)).alias("lines"), F.min("key").alias("least")).filter("lines > 1").select(*sets, "least"))
    named = narrow.join(copied, sets).filter("key = least").groupBy(*sets).agg(F.min(F.struct("at", "row")).alias("first"))
    return lines.join(_named(named.select(*sets, F.col("first.row").alias("kept"))), sets, "left").filter("kept IS NULL OR kept = row").drop("kept")


def _confirm(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The later lines ``k, t`` of those pairs whose whole token sets are similar enough.

    The lines concerned are named by a broadcast up to a bound, so that no other set is shuffled.
    """
    ids = pairs.select(F.col("xk").alias("key"), F.col("xt").alias("at")).unionAll(pairs.select(F.col("yk").alias("key"), F.col("yt").alias("at"))).distinct()
    sets = cut(lines.select("key", "at", "tokens").join(_named(ids), ["key", "at"]).dropDuplicates(["key", "at"]))
    one, two = sets.toDF("xk", "xt", "a"), sets.toDF("yk", "yt", "b")
    both = F.size(F.array_intersect("a", "b"))
    alike = pairs.join(one, ["xk", "xt"]).join(two, ["yk", "yt"]).filter(both * 100 >= (F.size("a") + F.size("b") - both) * percent)
    return alike.select(F.col("yk").alias("k"), F.col("yt").alias("t")).distinct()


def line_duplicates(docs: DataFrame, percent: int = 80, heads: int = 2, slices: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, hash, removed``: for each document with something to remove, the places of its lines.

    Lines are the text between line feeds; the order of lines is that of (id, place, text hash). A
    line is removed if an earlier line, removed or not, has the same token set or a Jaccard
    similarity of at least ``percent`` hundredths.

    1. Texts are tokenised once, to a table of lines with their hashed token sets.
    2. Lines of equal token sets become one, the first of them; only sets of several lines are named.
    3. All their tokens are counted; bounded lists say which hold a large share of all occurrences.
    4. Sets of similarity t share one of their first n - ceil(t n) + 1 tokens in order of rarity.
    5. Sets are first compared with the first ones (``heads``) of ``_CROWD`` or more that have the
       same three tokens at the start or at the end of their order of hashes. Most members of a large family
       of near copies are settled there.
    6. Sets not yet removed are compared with all earlier sets that share a prefix token and pass the
       length, positional and bitmap filters (all three lose nothing). Of two sets the smaller one
       needs a shorter prefix, since t / (1 + t) of both sizes must be shared, and they meet by
       token and class of sizes: a set is listed under its own class and the next one. A token of
       many lines counts only together with a second one: similar sets share two of one token more
       each. The index is made and joined in ``slices`` of its keys, one after the other, so that
       only a part of it is on disk.
    Both comparisons are on whole token sets, read again for the lines concerned only.
    """
    with tidy_shuffles(docs.sparkSession):
        return _line_duplicates(docs, percent, heads, slices, id_col, text_col)


def _line_duplicates(docs: DataFrame, percent: int, heads: int, slices: int, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    rows = docs.select(key.alias("key"), _plain(F.col(text_col)).alias("text"), F.xxhash64(text_col).alias("hash"))
    lines = rows.select("key", "hash", F.posexplode(F.split("text", "\n")).alias("place", "line")).select("key", "hash", "place", line_tokens(F.col("line")).alias("tokens"))
    lines = lines.select("*", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("s0"), F.xxhash64(F.lit("second"), F.col("tokens")).alias("s1"))
    lines = lines_table = written(lines.withColumn("row", F.monotonically_increasing_id()), "line-tokens", _HASHES)
    at = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)))
    lines = lines.filter("n > 0").withColumn("at", at)
    # below this many tokens only equal sets are similar enough
    least = 1 if percent < 50 else -(-100 // (100 - percent)) - 1 if percent < 100 else _LAST
    distinct = _first_lines(lines)
    frequent, often = _frequent(distinct)
    prefixed = _with_prefix(distinct, frequent, percent)
    size = _size_class(F.col("n"), percent)
    ends = [F.xxhash64(F.slice("tokens", start, 3), size).alias(c) for c, start in (("q0", F.lit(1)), ("q1", -F.least("n", F.lit(3))))]
    # a written table: the lists of tokens stay out of all later plans
    firsts = prefixed.select("s0", "s1", "n", F.col("key").alias("k"), F.col("at").alias("t"), *_bitmaps(), *ends, "prefix")
    firsts = firsts_table = written(firsts, "line-firsts", _HASHES)

    def entries(of: DataFrame) -> DataFrame:
        """One row for each ``i, token`` of ``of``; ``m`` is n, i and whether the line is open in one long."""
        m = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("bigint"), 1)).bitwiseOR(F.col("open").cast("bigint"))
        return of.select("token", "k", "t", m.alias("m"), "b", "c")

    able = firsts.filter(F.col("n") >= least)
    few = entries(able.select("k", "t", "n", "b", "c", F.lit(True).alias("open"), F.lit(0).alias("i"), F.explode(F.array("q0", "q1")).alias("token")))
    early = few.groupBy("token", F.pmod(F.xxhash64("k", "t"), F.lit(heads)).alias("salt")).agg(F.min(F.struct("k", "t", "m", "b", "c")).alias("e"), F.count(F.lit(1)).alias("lines"))
    near = cut(_joined(_named(early.filter(F.col("lines") >= _CROWD).select("token", "e.*")), few, percent, by_size=False))
    settled = cut(_confirm(near, lines, percent))
    marked = able.join(_named(settled.withColumn("settled", F.lit(True))), ["k", "t"], "left").withColumn("open", F.col("settled").isNull())
    first = F.slice("prefix", F.lit(1), _prefix_length(percent))
    dense = None
    if percent * least > 100:  # any two similar sets share two tokens
        counted = able.select(F.explode(first).alias("token")).join(_named(often), "token").groupBy("token").count()
        dense = cut(counted.filter(F.col("count") >= _DENSE).select("token", F.lit(True).alias("dense")))
        dense = None if dense.isEmpty() else _named(dense)

    # no more than the smallest size of the next class, to which the line is listed if a similar one can be as large
    above = F.greatest(F.floor(F.pow(F.lit(100 / percent), size + 1)), "n") if percent < 100 else F.col("n") + 1
    reaches = _size_class(F.floor(F.col("n") * 100 / percent), percent) > size
    columns = ["k", "t", "n", "b", "c", "open", "size"]

    def listed(part: int, length: Column, next_length: Column | None = None) -> DataFrame:
        """Entries by the first ``length`` tokens of each line (by pairs of dense ones with one token more), for partners of its class; those by the first ``next_length`` for partners of the next class too.

        No function with a lambda: the rows would leave generated code.
        """
        each = marked.withColumns({"length": length, "size": size, "next": F.lit(0) if next_length is None else next_length})
        each = each.select(*columns, "length", "next", "prefix", F.posexplode(F.slice("prefix", F.lit(1), F.greatest("length", F.lit(0)))).alias("i", "token"))
        each = each.filter(F.pmod("token", F.lit(slices)) == part)
        reach = F.col("i") + 1
        if dense is not None:
            each = each.join(dense, "token", "left")
            partners = F.when(F.col("dense"), F.slice("prefix", F.col("i") + 2, F.col("length") - F.col("i"))).otherwise(F.array("token"))
            each = each.select(*columns, "next", "dense", "token", "i", F.posexplode(partners).alias("j", "partner"))
            at = F.when(F.col("dense"), F.col("i") + 1 + F.col("j")).otherwise(F.col("i"))
            reach = F.when(F.col("dense"), F.col("i")).otherwise(F.col("i") + 1)
            each = each.select(*columns, "next", "dense", F.when(F.col("dense"), F.xxhash64("token", "partner")).otherwise(F.col("token")).alias("token"), at.alias("i"))
        if next_length is None:
            each = each.withColumn("under", F.col("size"))
        else:
            each = each.select(*columns, "token", "i", F.explode(F.when(reach <= F.col("next"), F.array("size", F.col("size") + 1)).otherwise(F.array("size"))).alias("under"))
        return entries(each.withColumn("token", F.xxhash64("token", "under")))

    pairs = []
    for part in range(slices):
        smaller = listed(part, _shared_prefix(F.col("n"), percent), F.when(reaches, _shared_prefix(above, percent)).otherwise(F.lit(0)))
        pairs.append(cut(_joined(smaller, listed(part, _prefix_length(percent)), percent, by_size=True)))
    rest = cut(reduce(DataFrame.unionAll, pairs).distinct().join(near, ["xk", "xt", "yk", "yt"], "left_anti"))
    similar = settled.unionAll(_confirm(rest, lines, percent)).distinct().withColumn("similar", F.lit(True))
    decided = firsts.select("k", "t", "s0", "s1", "n").join(similar, ["k", "t"], "left")
    decided = cut(decided.select("s0", "s1", "n", F.struct(F.col("k").alias("key"), F.col("t").alias("at")).alias("first"), F.coalesce("similar", F.lit(False)).alias("similar")))
    line = F.struct("key", "at")
    gone = lines.select("key", "hash", "place", "at", "s0", "s1", "n").join(decided.hint("shuffle_hash"), ["s0", "s1", "n"]).filter(F.col("similar") | (line != F.col("first")))
    removed = cut(gone.groupBy("key", "hash").agg(F.array_sort(F.collect_set("place")).alias("removed")))
    dropped(lines_table, firsts_table)
    return removed


def without_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lines``, ``_removed`` (places) and the text without the removed lines.

    Defined results: null texts have no lines; lines without a token are never removed; an empty
    text has one empty line. Rows with a null id come last in the order of lines. Rows that repeat
    id and text are one document: each keeps the same lines. All columns come back; columns of
    ``docs`` that are named ``_lines`` or ``_removed`` are replaced.
    """
    docs = replaced(docs, "_lines", "_removed")
    key_, hash_, gone_key, gone_hash = fresh(docs, "key", "hash", "gone_key", "gone_hash")
    gone = line_duplicates(docs, percent, id_col=id_col, text_col=text_col).toDF(gone_key, gone_hash, "_removed")
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    d = docs.withColumns({key_: key, hash_: F.xxhash64(text_col)})
    d = d.join(gone.hint("shuffle_hash"), (F.col(key_) == F.col(gone_key)) & (F.col(hash_) == F.col(gone_hash)), "left").drop(key_, hash_, gone_key, gone_hash)
    d = d.withColumn("_removed", F.coalesce("_removed", F.array().cast("array<int>")))
    all_ = F.split(text_col, "\n")
    kept = F.array_join(F.filter(all_, lambda line, i: ~F.array_contains("_removed", i)), "\n")
    n_lines = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    return d.withColumn("_lines", F.coalesce(n_lines, F.lit(0))).withColumn(text_col, F.when(F.size("_removed") > 0, kept).otherwise(F.col(text_col)))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("_lines")).alias("n_lines"),
        F.size("_removed").alias("n_removed"),
        F.col("_removed").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS place, list_sort(list_distinct(list_filter(
    string_split(translate(lower(lines[i]), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> ''))) AS tokens
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), s AS (
  SELECT tokens, len(tokens) AS n, min((doc_id, place)) AS first FROM l WHERE len(tokens) > 0 GROUP BY tokens
), e AS (
  SELECT first, n, unnest(tokens) AS token FROM s
), c AS (
  SELECT token, count(*) AS c FROM e GROUP BY token
), p AS (
  SELECT first, n, token FROM (
    SELECT first, n, token, row_number() OVER (PARTITION BY first ORDER BY c, token) AS r FROM e JOIN c USING (token)
  ) WHERE r <= n - ceil(0.8 * n - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT a.first AS x, b.first AS y FROM p a JOIN p b ON a.token = b.token AND a.first < b.first
    AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), matched AS (
  SELECT DISTINCT y FROM pairs JOIN s a ON a.first = x JOIN s b ON b.first = y
  WHERE 100 * len(list_intersect(a.tokens, b.tokens)) >= 80 * (a.n + b.n - len(list_intersect(a.tokens, b.tokens)))
), gone AS (
  SELECT l.doc_id, list(CAST(l.place AS INT) ORDER BY l.place) AS removed
  FROM l JOIN s USING (tokens) LEFT JOIN matched ON matched.y = s.first
  WHERE matched.y IS NOT NULL OR s.first <> (l.doc_id, l.place)
  GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(removed), 0) AS n_removed,
  coalesce(removed, []) AS removed_lines,
  sha256(CASE WHEN removed IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(removed, i - 1)), chr(10)) END) AS text_sha256
FROM documents d LEFT JOIN gone USING (doc_id)
"""
