"""Packing: ids as the library gives them, a plan that never overlaps, every case of awkward rows."""

from __future__ import annotations

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from helpers import DATA
from tokenizers import Tokenizer

from dramaturg.llm import packing
from dramaturg.llm.token_counts import char_classes


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(packing.vocabulary())


@pytest.fixture(scope="module")
def encoder():
    spec = packing.vocabulary()
    return packing.Encoder(spec, packing.told_apart(char_classes(spec)))


def test_ids_equal_the_library(library, encoder):
    draw = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "'re", "1", "²", "é", "日", "語", "😀", "!", "<|endoftext|>", "\x85", "\x1c", " ", "ǅ", "٣", "Ⅷ", "́", "‍", "…", "word", " the", "\r\n"]
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(chr(draw.choice(points)) + draw.choice(["a", "1", " ", ""]) for _ in range(20)) for _ in range(500)]
    assert all(library.encode(t, add_special_tokens=False).ids == encoder.ids(t).tolist() for t in texts)
    slow = packing.Encoder(packing.vocabulary(), "[é日]")
    assert all(slow.ids(t).tolist() == encoder.ids(t).tolist() for t in texts[:200])


def test_long_texts_are_cut_where_pieces_end(library, encoder):
    text = "some words'll be\nhere  and 12 there, " * 100_000
    assert len(list(packing.safe_parts(text))) > 2 and "".join(packing.safe_parts(text)) == text
    assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(packing.safe_parts("x" * (2 << 20))) == ["x" * (2 << 20)]


def placed(items, capacity):
    counts = [0] * (capacity + 1)
    for x in items:
        counts[x] += 1
    runs, made = packing.plan(counts, capacity)
    seen, fill = collections.Counter(), collections.defaultdict(list)
    for x in items:
        row = [r for r in runs.tolist() if r[0] == x and r[1] <= seen[x]][-1]
        along, beside = divmod(seen[x] - row[1], row[3])
        fill[row[2] + along].append((row[4] + beside * x, x))
        seen[x] += 1
    assert sorted(fill) == list(range(made))
    for own in fill.values():
        at = 0
        for offset, x in sorted(own):
            assert offset == at
            at += x
        assert at <= capacity
    return fill


def best_fit_decreasing(sizes, gaps, capacity):
    for x in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return gaps


def test_plan_equals_matching_and_best_fit_one_by_one():
    draw = random.Random(2)
    for _ in range(300):
        capacity = draw.choice([1, 2, 5, 7, 12, 30, 64, 1024])
        items = [draw.choice([draw.randint(1, capacity), draw.randint(1, max(1, capacity // 4))]) for _ in range(draw.randint(0, 150))]
        fill = placed(items, capacity)
        large, gaps = sorted((x for x in items if 3 * x > capacity), reverse=True), []
        while large:
            x = large.pop(0)
            y = next((y for y in large if x + y <= capacity), 0)
            if y:
                large.remove(y)
            gaps.append(capacity - x - y)
        gaps = best_fit_decreasing([x for x in items if 3 * x <= capacity], gaps, capacity)
        assert sorted(capacity - sum(x for _, x in own) for own in fill.values()) == sorted(gaps)


def test_matching_uses_as_few_sequences_as_any():
    draw = random.Random(3)

    def fewest(items, capacity):
        best = len(items)
        for deal in itertools.product(range(len(items)), repeat=len(items)):
            sums = collections.Counter()
            for x, b in zip(items, deal, strict=True):
                sums[b] += x
            if max(sums.values(), default=0) <= capacity:
                best = min(best, len(sums))
        return best

    for _ in range(12):
        items = [draw.randint(11, 30) for _ in range(5)]
        assert len(placed(items, 30)) == fewest(items, 30)


def test_runs_do_not_grow_with_the_number_of_pieces():
    draw = np.random.default_rng(1)
    for total in (10**6, 10**10):
        runs, made = packing.plan([0, *(total * draw.dirichlet(np.full(1024, 0.3))).astype(int).tolist()], 1024)
        assert len(runs) < 20_000 and made > 0


def laws(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["_sequence"]].append((r["_offset"], r["_length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_awkward_documents(spark, awkward, nothing, library):
    import pyspark.sql.functions as F

    docs = awkward.withColumn("_sequence", F.lit("own")).withColumn("_PIECE", F.lit(1))
    packed = packing.pack(packing.pieces(docs, packing.vocabulary(), 64), 64).cache()
    rows = packed.collect()
    laws(rows, 64)
    assert [c for c in packed.columns if c.lower() == "_piece"] == ["_piece"] and packed.columns.count("_sequence") == 1 and {"lang", "hash"} <= set(packed.columns)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["_piece"]):
        got[r["doc_id"], r["lang"]].append(r)
    for r in awkward.collect():
        want = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        own = got[r["doc_id"], r["lang"]]
        copies = 2 if r["doc_id"] == 7 else 1
        flat = np.concatenate([np.frombuffer(p["_ids"], "<u4") for p in own[::copies]])
        assert flat.tolist() == want and len(own) == copies * -(-len(want) // 64)
        assert [p["_start"] for p in own[::copies]] == np.cumsum([0, *(p["_length"] for p in own[::copies])])[:-1].tolist()
        assert all(p["_length"] == 64 for p in own[copies:])
    joined = {r["_sequence"]: r["_ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r["_sequence"]][4 * r["_offset"]: 4 * (r["_offset"] + r["_length"])] == bytes(r["_ids"])
    packed.unpersist()
    assert packing.pack(packing.pieces(nothing, packing.vocabulary())).count() == 0


def test_wrong_lengths_are_errors(spark):
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(5,)], "_length bigint"), 4).count()


def test_query_equals_brute_force(spark, library):
    rows = packing.op13_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    total = 0
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        start = 0 if r["piece"] == 0 else first + 1024 * (r["piece"] - 1)
        length = first if r["piece"] == 0 else 1024
        assert (r["start"], r["length"]) == (start, length)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[start: start + length], "<u4").tobytes())
        total += length
    made = laws([{"_sequence": r["sequence_id"], "_offset": r["offset"], "_length": r["length"]} for r in rows], 1024)
    assert made <= 1.02 * -(-total // 1024) + 1
