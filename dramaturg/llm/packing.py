"""Best-fit packing of tokenised documents into training sequences (operator 13).

Documents become token ids with an end id, and longer ones are cut into pieces. The number of pieces
of each length is all that packing needs: a plan made from these counts says, for runs of equal
lengths, into which sequences they go and where. Pieces of over a third of a sequence are matched
first, at most two of them a sequence; the smaller ones are put, longest first, into the tightest
gap that holds them. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, extended, fresh, replaced, small_batches, table, written
from dramaturg.llm.token_counts import LETTER, NUMBER, OTHER, SPACE, byte_letters, char_classes

#: Fixed value: the pieces that byte-level merges stay inside (one space may come before a run).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_RANK_BITS = 44


def encoding(spec: dict):
    """A byte-pair encoder with the vocabulary, merge order and special tokens of a vocabulary file."""
    import tiktoken

    pre, model = spec["pre_tokenizer"], spec["model"]
    if pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] or model["type"] != "BPE":
        raise ValueError("only byte-level BPE without a normaliser is read")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    made = {"".join(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    ranks, ids = {}, {}
    for token, number in model["vocab"].items():
        if token in special:
            continue
        raw = bytes(letters[c] for c in token)
        # single bytes come first, then tokens in the order of their merges; others never come out
        rank = raw[0] if len(raw) == 1 else made[token] + 256 if token in made else None
        if rank is not None:
            ranks[raw], ids[rank] = rank, number
    own = np.zeros(max(ids) + 2 + len(special), np.uint32)
    for rank, number in ids.items():
        own[rank] = number
    extra = {content: max(ranks.values()) + 1 + i for i, content in enumerate(special)}
    for content, rank in extra.items():
        own[rank] = special[content]
    return tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=extra), own


def told_apart(classes: np.ndarray) -> str | None:
    """A pattern of the characters that the encoder takes for another class than ``classes`` says; None if there are none.

    The encoder is asked: with merges of a letter, a figure and a mark with every first byte of a
    character, it merges across only where both are in one piece.
    """
    import tiktoken

    points = [p for p in [*range(0x80, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]]
    ranks = {bytes((b,)): b for b in range(256)}
    for first in "a1!":
        for lead in range(0xC2, 0xF5):
            ranks[first.encode() + bytes((lead,))] = len(ranks)
    asked = tiktoken.Encoding("classes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    seen = np.full(len(points), SPACE, np.uint8)
    for first, kind in zip("a1!", (LETTER, NUMBER, OTHER), strict=True):
        lines = [f"{first}{chr(p)}\n" for p in points]
        at = np.cumsum([0, *(len(x.encode()) for x in lines)])[:-1]
        lengths = 1 + (asked.encode_to_numpy("".join(lines)) >= 256).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        joined = np.zeros(int(lengths.sum()), bool)
        joined[starts[lengths == 2]] = True
        seen[joined[at]] = kind
    odd = [p for p, s in zip(points, seen.tolist(), strict=True) if s != classes[p]]
    return f"[{''.join(re.escape(chr(p)) for p in odd)}]" if odd else None


def safe_parts(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text in parts, cut before a space or line end between two word characters, where pieces end anyway."""
    seam = re.compile(r"(?<=\w)[ \n](?=\w)")
    at = 0
    while len(text) - at > most:
        found = seam.search(text, at + most)
        if found is None:
            break
        yield text[at: found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level vocabulary file.

    Texts go through the faster encoder with the same merges, but for those with a character that
    the two libraries put in different classes.
    """

    def __init__(self, tokenizer_json: str, odd: str | None):
        self._json, self._odd = tokenizer_json, re.compile(odd) if odd else None
        self._fast, self._own = encoding(json.loads(tokenizer_json))
        self._library = None

    def ids(self, text: str) -> np.ndarray:
        if self._odd and not text.isascii() and self._odd.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self._json)
                self._library.no_truncation()
                self._library.no_padding()
            parts = [np.array(self._library.encode(p, add_special_tokens=False).ids, np.uint32) for p in safe_parts(text)]
        else:
            parts = [self._own[self._fast.encode_to_numpy(p, allowed_special="all")] for p in safe_parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=2)
def _encoder(tokenizer_json: str, odd: str | None) -> Encoder:
    return Encoder(tokenizer_json, odd)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Only what is longer than ``capacity`` is cut; the first piece is what the others leave."""
    return [(n - 1) % capacity + 1] + [capacity] * ((n - 1) // capacity)


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with ``_piece, _start, _length`` and ``_ids`` (little-endian unsigned 32-bit), a row a piece.

    Defined results: null and empty texts are the end id alone; special strings in texts are their
    special token; repeated rows are pieces of their own; other columns pass through, and those
    named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = replaced(docs, "_piece", "_start", "_length", "_ids")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, told_apart(char_classes(tokenizer_json))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, number, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                own = np.concatenate([encoder.ids(text or ""), end]).astype("<u4", copy=False)
                begin = 0
                for j, size in enumerate(piece_lengths(own.size, capacity)):
                    row.append(i)
                    number.append(j)
                    start.append(begin)
                    length.append(size)
                    ids.append(own[begin: begin + size].tobytes())
                    begin += size
            kept = batch.select([k for k in range(batch.num_columns) if k != at]).take(pa.array(row, pa.int64()))
            made = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "_piece", "_start", "_length", "_ids"])

    return docs.mapInArrow(run, extended(docs.drop(text_col), "_piece int, _start bigint, _length bigint, _ids binary"))


def plan(counts: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Where pieces go, and the number of sequences; ``counts[s]`` pieces have the length ``s``.

    A row ``length, rank, sequence, each, offset`` says: from that rank on, pieces of that length go
    ``each`` at a time into consecutive sequences, starting at ``sequence``, side by side from
    ``offset``. Sequences with equal gaps are handled together, so the work and the number of rows
    depend on the capacity, not on the number of pieces: a run either ends its length or fills a
    group of sequences, whose gap at least halves by it.
    """
    left, given = list(counts), [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, made = [], 0

    def put(s: int, first: int, n: int, each: int, offset: int) -> None:
        runs.append((s, given[s], first, each, offset))
        given[s] += n * each
        left[s] -= n * each

    least = capacity // 3 + 1  # of these at most two fit
    for s in range(capacity, least - 1, -1):
        while left[s]:
            # greedy matching: the longest piece takes the longest partner that fits
            t = next((t for t in range(min(s, capacity - s), least - 1, -1) if left[t] > (t == s)), 0)
            n = left[s] if not t else left[s] // 2 if t == s else min(left[s], left[t])
            put(s, made, n, 2 if t == s else 1, 0)
            if t and t != s:
                put(t, made, n, 1, s)
            gaps[capacity - s - t].append((made, n))
            made += n
    for s in range(least - 1, 0, -1):
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if gaps[g]), 0)
            if gap:
                first, n = gaps[gap].pop()
            else:  # nothing holds it: as many new sequences as the rest of this length fills
                gap, first, n = capacity, made, -(-left[s] // (capacity // s))
                made += n
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, first, full, each, capacity - gap)
                gaps[gap - each * s].append((first, full))
            if full < n and left[s]:
                rest = left[s]
                put(s, first + full, 1, rest, capacity - gap)
                gaps[gap - rest * s].append((first + full, 1))
                full += 1
            if full < n:
                gaps[gap].append((first + full, n - full))
    return np.array(sorted(runs), np.int64).reshape(-1, 5), made


def _numbered(rows: DataFrame, length: str, part: str, rank: str, capacity: int) -> DataFrame:
    """``rows`` with the task that read them and their rank among its rows of the same length."""
    at = rows.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False)
            if sizes.size and not (sizes.min() >= 1 and sizes.max() <= capacity):
                raise ValueError(f"lengths must be 1 to {capacity}")
            order = np.argsort(sizes, kind="stable")
            count = np.bincount(sizes, minlength=capacity + 1)
            place = np.empty(sizes.size, np.int64)
            place[order] = np.arange(sizes.size) - (np.cumsum(count) - count)[sizes[order]]
            place += seen[sizes]
            seen += count
            tasks = pa.array(np.full(sizes.size, task, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, tasks, pa.array(place)], names=[*batch.schema.names, part, rank])

    return rows.mapInArrow(run, extended(rows, f"`{part}` int, `{rank}` bigint"))


def pack(rows: DataFrame, capacity: int = 1024, length: str = "_length") -> DataFrame:
    """``rows`` with ``_sequence`` and ``_offset``: pieces lie side by side from 0 and never overlap.

    ``rows`` are written once; counts by task and length (at most ``capacity`` each) give every row
    its rank among equal lengths. The plan on the driver sees one count a length, at most
    ``capacity`` of them, which also bounds what is broadcast. Hot lengths are ranked by tasks, so
    no group of rows meets in one place.

    Defined results: no rows give none; equal rows get places of their own; other columns pass
    through; columns named like the new ones are replaced. A length outside 1 to ``capacity`` is an
    error.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = replaced(rows, "_sequence", "_offset")
    part, rank, before, n = fresh(rows, "part", "rank", "before", "n")
    rows = written(_numbered(rows, length, part, rank, capacity), "pieces")
    counts = cut(rows.groupBy(part, length).agg(F.count(F.lit(1)).alias(n)))
    totals = [0] * (capacity + 1)
    for size, total in counts.groupBy(length).agg(F.sum(n)).collect():
        totals[size] = total
    shared = spark.sparkContext.broadcast(plan(totals, capacity)[0])
    earlier = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, length, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    ranked = rows.join(starts, [part, length]).select(*[c for c in rows.columns if c not in (part, rank)], (F.col(rank) + F.col(before)).alias(rank))
    at = ranked.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << _RANK_BITS) | runs[:, 1]
        for batch in batches:
            sizes, ranks = batch.column(at).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_numpy()
            own = runs[np.searchsorted(keys, (sizes.astype(np.int64) << _RANK_BITS) | ranks, side="right") - 1]
            along, beside = np.divmod(ranks - own[:, 1], own[:, 3])
            made = [pa.array(own[:, 2] + along), pa.array(own[:, 4] + beside * sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_sequence", "_offset"])

    return ranked.mapInArrow(run, extended(ranked.drop(rank), "_sequence bigint, _offset bigint"))


def sequences(packed: DataFrame) -> DataFrame:
    """``_sequence, _ids``: the ids of each sequence's pieces, one after the other; at most ``capacity`` ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("_offset", "_ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda got, part: F.concat(got, part["_ids"]))
    return packed.groupBy("_sequence").agg(joined.alias("_ids"))


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op13_packing(spark: SparkSession, sf_dir: str, capacity: int = 1024) -> DataFrame:
    own = pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), capacity)
    packed = pack(own.select("doc_id", "_piece", "_start", "_length", F.crc32("_ids").alias("_crc")), capacity)
    return packed.select(
        "doc_id", F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_crc").alias("ids_crc32"),
        F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"),
    )
