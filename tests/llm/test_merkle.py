"""The manifest against a tree built node by node, its positions, and awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from dramaturg.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's path, level by level."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, spot in zip(paths, spots, strict=True):
            low = spot - spot % 16
            path.append(("".join(level[low:spot]), "".join(level[spot + 1: low + 16])))
        level = [sha(*level[i: i + 16]) for i in range(0, len(level), 16)]
        spots = [s // 16 for s in spots]
    return level[0], paths


def expected(rows, claims):
    """``rows``: (group, order, leaf); the root and, for each row, what a checker finds."""
    groups = {}
    for i, (group, order, leaf) in enumerate(rows):
        groups.setdefault(group, []).append((order is not None, order, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    own = {g: tree([x[2] for x in groups[g]]) for g in names}
    root, above = tree([own[g][0] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        for (_, order, leaf, i), path in zip(groups[g], own[g][1], strict=True):
            path = path + up
            found = claims[i] or leaf
            for before, after in path:
                found = sha(before, found, after)
            out.append((order, leaf, own[g][0], root, sha(*(x for s in path for x in s)), found, found == root))
    return sorted(out, key=str)


def got(spark, rows, claims):
    frame = spark.createDataFrame([(*r, c) for r, c in zip(rows, claims, strict=True)], "g string, o bigint, leaf string, claim string").repartition(5)
    manifest = merkle.build(frame, "g", "o", "leaf", F.struct(F.col("o").alias("doc_id"), "claim"))
    return manifest, sorted((tuple(r) for r in merkle.checked(manifest).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17, 1], [256, 255, 257], [4096, 4097, 3]])
def test_equals_a_tree_built_node_by_node(spark, sizes):
    rows = [(f"g{g}" if g else None, i * 7 % n, sha(str(g), str(i))) for g, n in enumerate(sizes) for i in range(n)]
    claims = [sha("other") if i % 5 == 0 else None for i in range(len(rows))]
    assert got(spark, rows, claims)[1] == expected(rows, claims)


def test_many_groups_and_a_hot_one_take_several_rounds(spark):
    rows = [("hot", i, sha(str(i))) for i in range(9000)] + [(f"ß{i}" if i % 2 else f"z{i}", 5, sha("x")) for i in range(4300)]
    claims = [None] * len(rows)
    manifest, found = got(spark, rows, claims)
    assert len(manifest.rounds) == 2 and len(manifest.over) == 2
    assert found == expected(rows, claims)


def test_positions_are_those_of_a_postorder_walk():
    for leaves in (1, 2, 15, 16, 17, 33, 256, 257, 300):
        top = merkle.height(leaves)
        seen = []

        def visit(level, at, leaves=leaves, seen=seen):
            if level:
                for j in range(16 * at, min(16 * at + 16, -(-leaves // 16 ** (level - 1)))):
                    visit(level - 1, j)
            seen.append((level, at))

        visit(top, 0)
        assert [merkle.position(level, at, leaves, top) for level, at in seen] == list(range(len(seen)))
        log = merkle.append_log([sha(str(i)).encode() for i in range(leaves)], top)
        assert len(log) == 64 * len(seen) and log[-64:].decode() == tree([sha(str(i)) for i in range(leaves)])[0]


def test_equal_rows_nulls_and_no_rows(spark):
    rows = [("a", 1, sha("t"))] * 50 + [(None, None, sha("n"))] * 3 + [("", 2, sha("e")), ("a", None, sha("t"))]
    claims = [None] * len(rows)
    assert got(spark, rows, claims)[1] == expected(rows, claims)
    manifest, found = got(spark, [], [])
    assert manifest.root is None and found == [] and merkle.proofs(manifest).count() == 0


def test_proofs_and_logs(spark):
    rows = [("a", i, sha(str(i))) for i in range(40)] + [("b", 1, sha("b"))]
    manifest, _ = got(spark, rows, [None] * len(rows))
    for r in merkle.proofs(manifest).collect():
        assert merkle.folded(r["leaf"], [(s["before"], s["after"]) for s in r["path"]]) == manifest.root
    logged = merkle.nodes(manifest.rounds[0]).collect()
    assert sorted(r["position"] for r in logged) == sorted([0, *range(40 + 3 + 1)])
    assert {s["digest"] for s in manifest.subroots.collect()} <= {r["digest"] for r in logged}


def test_leaves_and_tampering(spark, awkward):
    """Columns that clash are left alone; what a leaf hashes is spelled out here."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    frame = awkward.withColumn("leaf", merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))).withColumn("_at", F.lit(1)).withColumn("tree", F.lit("x"))
    for r in frame.collect():
        assert r["leaf"] == sha(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    manifest = merkle.build(frame, "source", "doc_id", "leaf", F.struct("doc_id", F.lit(None).cast("string").alias("claim")))
    found = merkle.checked(manifest).collect()
    assert len(found) == awkward.count() and all(r["verified"] for r in found)


def test_query_tampers_where_it_should(spark):
    from helpers import DATA

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in merkle.op11_merkle_manifest(spark, DATA).collect():
        text = texts[r["doc_id"]]
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (not touched)
