"""Merkle manifest of a table: hash trees in postorder logs, proofs read by position (operator 11).

Every row is a leaf; runs of 16 nodes become their parent until one is left. A tree is built by
aligned builders: each takes 4096 consecutive leaves, three levels of the tree, and appends the
nodes as they are complete, so a builder's part of the log is in postorder. The place of any node
in it follows from the sizes of the subtrees before it, hence siblings are read by position and
never searched. The builders' last nodes are the leaves of the next round, until one node is left.
The trees of all groups, and the tree over them, are built by the same rounds.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dramaturg.llm._shared import cut, id_residue, small_batches, table, written

FANOUT, LEVELS = 16, 3
SPAN = FANOUT**LEVELS
_HEX = 64


def digest(*parts: str | bytes) -> str:
    """Lower-case hex SHA-256 of the inputs, one after the other."""
    h = hashlib.sha256()
    for part in parts:
        h.update(part.encode("utf-8") if isinstance(part, str) else part)
    return h.hexdigest()


def field(value: Column) -> Column:
    """A value as the leaf's hash takes it: ``-`` if null, else its UTF-8 bytes counted, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def subtree(level: int, leaves: int) -> int:
    """Nodes of a subtree with its root at ``level`` over so many leaves."""
    return sum(-(-leaves // FANOUT**m) for m in range(level + 1))


def position(level: int, at: int, leaves: int, top: int) -> int:
    """The place in postorder of node ``at`` of ``level``, in a tree over ``leaves`` with its root at ``top``.

    Before the node's own subtree stand, of each level, the nodes that were full when its first
    leaf came; the node itself ends its subtree.
    """
    first = at * FANOUT**level
    before = sum(first // FANOUT**m for m in range(top + 1))
    return before + subtree(level, min(FANOUT**level, leaves - first)) - 1


def height(leaves: int) -> int:
    """Levels above the leaves: none for a lone leaf."""
    h = 0
    while FANOUT**h < leaves:
        h += 1
    return h


def append_log(leaves: list[bytes], top: int) -> bytes:
    """The nodes over ``leaves`` up to level ``top``, 64 bytes each, in the order in which they are complete."""
    out: list[bytes] = []
    pending: list[list[bytes]] = [[] for _ in range(top + 1)]
    last = len(leaves) - 1
    for i, node in enumerate(leaves):
        for level in range(top + 1):
            out.append(node)
            if level == top:
                break
            pending[level].append(node)
            if len(pending[level]) < FANOUT and i < last:
                break
            node = digest(*pending[level]).encode()
            pending[level] = []
    return b"".join(out)


Path = list[tuple[str, str]]


def walk(log: bytes, leaves: int, top: int, rest: Path) -> Iterator[tuple[int, str, Path]]:
    """Every leaf of a builder's log with its hash and path: the siblings before and after it, level by level, then ``rest``.

    Nodes are read by their positions; what lies above a node is shared by all below it.
    """
    above = [rest]
    for level in range(top - 1, -1, -1):
        width = -(-leaves // FANOUT**level)
        own = [log[_HEX * p: _HEX * p + _HEX].decode() for p in (position(level, at, leaves, top) for at in range(width))]
        runs = [own[low: low + FANOUT] for low in range(0, width, FANOUT)]
        paths = [[("".join(run[:i]), "".join(run[i + 1:])), *above[r]] for r, run in enumerate(runs) for i in range(len(run))]
        if not level:
            yield from ((at, own[at], path) for at, path in enumerate(paths))
        above = paths
    if not top:
        yield 0, log.decode(), rest


def folded(start: str, path: Path) -> str:
    """The root that a leaf and its path lead to."""
    return reduce(lambda node, step: digest(step[0], node, step[1]), path, start)


@dataclass
class Manifest:
    """``rounds[r]``: builders' logs of round r (``tree, builder, leaves, top, log`` and, in the first, ``members``);
    ``over``: the same for the tree over all groups; ``groups``: ``tree`` and the grouping column; ``root``: its hash, None if there are no rows."""

    rounds: list[DataFrame]
    over: list[DataFrame]
    groups: DataFrame
    subroots: DataFrame
    root: str | None


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_at``, the place in its group ``by`` in the given order, and ``by, _n`` with each group's size.

    Rows are dealt to ranges of (group, order), so a hot group takes many tasks; counts by task give
    where each of its ranges begins. ``order`` should tell all rows apart; equal ones stay in one task.
    """
    row, part, first, before, n = "_row", "_part", "_first", "_before", "_n"
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(row, F.monotonically_increasing_id())
    dealt = written(dealt, "ranked").withColumn(part, F.shiftright(row, 33))
    counts = cut(dealt.groupBy(part, *by).agg(F.min(row).alias(first), F.count(F.lit(1)).alias(n)))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [part, *by]])
    placed = dealt.alias("l").join(starts.alias("r"), same).select(*[f"l.{c}" for c in rows.columns], (F.col(row) - F.col(first) + F.col(before)).alias("_at"))
    return placed, counts.groupBy(*by).agg(F.sum(n).alias(n))


def _logs(members: DataFrame) -> DataFrame:
    """One row a builder from ``tree, n, at, digest, member``: ``tree, builder, n, leaves, top, log, members``."""
    parts = F.sort_array(F.collect_list(F.struct("at", "digest", "member")))
    grouped = members.groupBy("tree", "n", F.shiftright("at", 4 * LEVELS).alias("builder")).agg(parts.alias("parts"))
    grouped = grouped.select("tree", "builder", "n", F.col("parts.digest").alias("digests"), F.col("parts.member").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, leaves = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tops = [min(LEVELS, height(n)) for n in sizes]
            logs = [append_log([x.encode() for x in own], top) for own, top in zip(leaves, tops, strict=True)]
            made = [pa.array(list(map(len, leaves)), pa.int32()), pa.array(tops, pa.int32()), pa.array(logs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, batch.column(4)], names=["tree", "builder", "n", "leaves", "top", "log", "members"])

    kind = members.schema["member"].dataType.simpleString()
    return grouped.mapInArrow(run, f"tree bigint, builder bigint, n bigint, leaves int, top int, log binary, members array<{kind}>")


def _build(members: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds over ``tree, n, at, digest, member``, and ``tree, digest`` of the last nodes; trees have at most ``largest`` leaves."""
    rounds, tops = [], None
    while True:
        logs = written(_logs(members), "logs")
        rounds.append(logs)
        last = F.decode(F.substring("log", F.octet_length("log") - _HEX + 1, F.lit(_HEX)), "utf-8")
        ends = logs.select("tree", F.ceil(F.col("n") / SPAN).alias("n"), F.col("builder").alias("at"), last.alias("digest"), F.lit(None).cast("boolean").alias("member"))
        done = ends.filter("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionAll(done)
        largest = -(-largest // SPAN)
        if largest <= 1:
            return rounds, tops
        members = ends.filter("n > 1")


def build(leaves: DataFrame, group: str, order: str, digest_col: str, member: Column) -> Manifest:
    """The manifest of rows that have their leaf's hash in ``digest_col``.

    One tree a value of ``group`` (null first, then bytewise), leaves ascending by ``order`` (null
    first, then by hash); ``member`` is kept with each leaf for those who read proofs. Besides
    hashes nothing of a row is moved. The driver sees the size of the largest group, the number of
    groups and the root.

    Defined results: equal rows are leaves of their own; without rows there are no logs and no root.
    """
    small_batches(leaves.sparkSession)
    # the row's number tells equal rows apart, so that a hot one is dealt to several tasks
    own = leaves.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(digest_col).alias("digest"), member.alias("member"), F.monotonically_increasing_id().alias("salt"))
    placed, sizes = _ranked(written(own, "leaves"), ["group"], ["order", "digest", "salt"])
    numbered, trees = _ranked(sizes.withColumn("_all", F.lit(0)), ["_all"], ["group"])
    groups = cut(numbered.select(F.col("_at").alias("tree"), "group", F.col("_n").alias("n")))
    largest, count = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    members = placed.join(groups, placed["group"].eqNullSafe(groups["group"])).select("tree", "n", F.col("_at").alias("at"), "digest", "member")
    rounds, tops = _build(members, largest or 0)
    subroots = cut(tops)
    tree = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(count).cast("bigint").alias("n"), F.col("tree").alias("at"), "digest", F.lit(None).cast("boolean").alias("member"))
    over, top = _build(tree, count)
    root = top.first()
    return Manifest(rounds, over, groups.withColumnRenamed("group", group).drop("n"), subroots, root["digest"] if root else None)


def nodes(logs: DataFrame) -> DataFrame:
    """A round's logs as rows ``tree, builder, position, digest``."""
    at = F.posexplode(F.sequence(F.lit(0), (F.octet_length("log") / _HEX).cast("int") - 1))
    return logs.select("tree", "builder", "log", at.alias("position", "_p")).select(
        "tree", "builder", "position", F.decode(F.substring("log", F.col("position") * _HEX + 1, F.lit(_HEX)), "utf-8").alias("digest")
    )


_PATH = "array<struct<before:string,after:string>>"


_ABOVE = f"tree bigint, at bigint, ends boolean, path {_PATH}, carried string"


def _descended(logs: DataFrame, above: DataFrame | None, make, fields: str) -> DataFrame:
    """A row of ``fields`` for every leaf of a round: what ``make`` makes of its tree, place, hash, member, path and what is carried.

    ``above`` has the paths of the builders' last nodes; None where they have none above them.
    """
    if above is None:
        given = logs.withColumn("path", F.array().cast(_PATH)).withColumn("carried", F.lit(None).cast("string"))
    else:
        ends = logs.withColumn("ends", F.col("n") <= SPAN).withColumnRenamed("builder", "at")
        given = ends.join(above, ["tree", "at", "ends"]).withColumnRenamed("at", "builder")
    given = given.select("tree", "builder", "leaves", "top", "log", "members", "path", "carried")
    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, builder, leaves, top, log, members, path, carried = (c[i].as_py() for c in batch.columns)
                rows = (make(tree, builder * SPAN + at, own, members[at], steps, carried) for at, own, steps in walk(log, leaves, top, [(p["before"], p["after"]) for p in path]))
                for part in batched(rows, 512):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*part, strict=True), arrow, strict=True)], names=arrow.names)

    return given.mapInArrow(run, schema)


def _as_steps(path: Path) -> list[dict]:
    return [{"before": a, "after": b} for a, b in path]


def _down(rounds: list[DataFrame], tops: DataFrame | None, make, fields: str) -> DataFrame:
    """:func:`_descended` from the last round to the first; ``tops`` has the paths of whole trees."""
    known = tops
    for logs in rounds[:0:-1]:
        lower = _descended(logs, known, lambda tree, at, own, member, path, carried: (tree, at, False, _as_steps(path), carried), _ABOVE)
        known = lower if tops is None else tops.unionAll(lower)
    return _descended(rounds[0], known, make, fields)


def described(manifest: Manifest, make, fields: str) -> DataFrame:
    """A row of ``fields`` for every leaf of the manifest, made of its tree, place, hash, member, path and subroot.

    Paths are read downwards, a round at a time, and only those of builders (one of 4096 leaves)
    are moved.
    """
    groups = _down(manifest.over, None, lambda _, at, own, member, path, carried: (at, 0, True, _as_steps(path), own), _ABOVE)
    return _down(manifest.rounds, groups, make, fields)


def proofs(manifest: Manifest) -> DataFrame:
    """``tree, at, leaf, member, subroot, path`` of every leaf; a path's steps have the siblings before and after."""
    kind = manifest.rounds[0].schema["members"].dataType.elementType.simpleString()
    return described(
        manifest, lambda tree, at, own, member, path, subroot: (tree, at, own, member, subroot, _as_steps(path)),
        f"tree bigint, at bigint, leaf string, member {kind}, subroot string, path {_PATH}",
    )


def checked(manifest: Manifest) -> DataFrame:
    """Proofs of a manifest whose members are ``doc_id`` and ``claim``, a leaf's hash now (null: as it was), folded to a root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    root = manifest.root

    def make(tree, at, own, member, path, subroot):
        found = folded(member["claim"] or own, path)
        return member["doc_id"], own, subroot, root, digest(*(x for step in path for x in step)), found, found == root

    return described(manifest, make, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", leaf(*before, F.col("text")).alias("leaf"), F.when(id_residue("doc_id", 5) == 0, leaf(*before, lowered)).alias("claim"))
    return checked(build(leaves, "source", "doc_id", "leaf", F.struct("doc_id", "claim")))


def sql(levels: int = 6) -> str:
    """The same in SQL, for groups of at most 16 to the power ``levels`` rows and as many groups."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in [*fields, text]) + ")"

    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
        "list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END), 4294967295)"
    )
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"WITH l0 AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(lowered)} END AS claim FROM documents)",
        "m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM l0)",
        "t AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM m))",
        "a0 AS (SELECT tree, spot, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source)",
    ]

    def climb(a: str) -> None:
        for k in range(levels):
            parts.append(
                f"{a}{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN spot // 16 ELSE spot END AS spot, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY {a}{k}.spot)) ELSE any_value(h) END AS h, "
                f"(any_value(n) + 15) // 16 AS n FROM {a}{k} GROUP BY tree, CASE WHEN n > 1 THEN spot // 16 ELSE spot END)"
            )

    def descend(a: str, p: str, first: str, columns: str) -> None:
        parts.append(f"{p}0 AS ({first})")
        for k in range(levels):
            own = f"(SELECT string_agg(s.h, '' ORDER BY s.spot) FROM {a}{k} s WHERE s.tree = q.tree AND s.spot // 16 = q.spot // 16 AND s.spot {{}} q.spot)"
            parts.append(
                f"{p}{k + 1} AS (SELECT {columns}, tree, CASE WHEN n > 1 THEN spot // 16 ELSE spot END AS spot, (n + 15) // 16 AS n, "
                f"CASE WHEN n > 1 THEN proof || b || f ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256(b || node || f) ELSE node END AS node "
                f"FROM (SELECT q.*, coalesce({own.format('<')}, '') AS b, coalesce({own.format('>')}, '') AS f FROM {p}{k} q))"
            )

    climb("a")
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS spot, h, count(*) OVER () AS n FROM a{levels})")
    climb("b")
    descend("a", "p", "SELECT m.doc_id, m.leaf, t.tree, m.spot, a0.n, '' AS proof, coalesce(claim, leaf) AS node FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source JOIN a0 ON a0.tree = t.tree AND a0.spot = m.spot", "doc_id, leaf")
    descend("b", "o", f"SELECT doc_id, leaf, a.h AS subroot, 0 AS tree, p.tree AS spot, b0.n, proof, node FROM p{levels} p JOIN a{levels} a ON a.tree = p.tree JOIN b0 ON b0.spot = p.tree", "doc_id, leaf, subroot")
    head = ",\n".join(parts)
    return f"{head}\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b.h AS verified FROM o{levels} CROSS JOIN b{levels} b"


SQL = sql()
