"""Defined results of awkward rows, laws, and brute force where SQL has no word for it."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from helpers import DATA, canonical
from pyspark.sql import functions as F

from dramaturg.llm import components as C
from dramaturg.llm import decontamination, exact_dedup, language_id, line_dedup, mixing, near_dedup, quality, registry, sharding, sketching, token_counts, warc
from dramaturg.llm._words import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["_shard"]].append(r)
    for members in by.values():
        assert sorted(r["_slot"] for r in members) == list(range(len(members)))
    return [sum(r["_size"] for r in by.get(s, [])) for s in range(shards)]


def test_shards_are_even(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.shard(docs, 8).collect()
    sizes = check_shards(rows, 8)
    assert len(rows) == docs.count() and sum(sizes) == sum(len((r["text"] or "").encode()) + 8 for r in rows)
    assert max(sizes) - min(sizes) <= 2 * max(r["_size"] for r in rows)


def test_a_hot_text_fills_several_shards(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = sharding.shard(docs, 6).collect()
    sizes = check_shards(rows, 6)
    assert max(sizes) < 1.02 * min(sizes)
    assert len({r["_shard"] for r in rows if r["text"] == "hot"}) in (2, 3, 4)


def test_shards_of_awkward_rows(awkward, nothing):
    rows = sharding.shard(awkward, 4).collect()
    check_shards(rows, 4)
    assert len(rows) == awkward.count() and {r["_size"] for r in rows if r["text"] is None} == {8}
    assert "bucket" in rows[0].asDict() and sharding.shard(nothing, 4).count() == 0


def test_exact_dedup(awkward, nothing):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(awkward).collect()}
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest()
    assert got[4, digest("")]["keep_id"] == 4 and got[5, digest("")]["keep_id"] == 4 and got[4, digest("")]["group_size"] == 2
    assert got[6, digest(" ")]["group_size"] == 1
    seven = got[7, digest("one two")]
    assert (seven["keep_id"], seven["group_size"], seven["kept"]) == (7, 2, True)
    assert not got[2, digest(next(r["text"] for r in awkward.filter("doc_id = 2").collect()))]["kept"]
    assert exact_dedup.exact_dedup(awkward).count() == awkward.count() and exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_tells_colliding_hashes_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lpad(F.hex(F.length(c)), 32, "0"))
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_shingles_equal_brute_force():
    texts = ["", None, "a", "a b c", "A  b\tc\x0bd e f a b c d", "é è \x1c x y z", "w " * 3000 + "end"]
    for k in (1, 4, 5):
        assert [len(s) for s in shingle_sets(texts, k)] == [len(shingle_set(t, k)) for t in texts]
    one, two = shingle_sets(["a b c d e", "x a b c d e"], 5)
    assert set(one) <= set(two)


def test_shingles_do_not_depend_on_the_batch():
    text = "a b c d e f g h i j"
    alone = shingle_sets([text], 5)[0].tolist()
    for company in (["y" * 5000], [" " * 5000], [""] * 2000, [None] * 2000, ["x " + "y" * 1500 + " z"]):
        assert shingle_sets([*company, text], 5)[-1].tolist() == alone
        assert shingle_sets([text, *company], 5)[0].tolist() == alone
    long = [text + " " + "y" * n + " " * m + "end" for n in (1023, 1024, 1025, 5000) for m in (1, 3000)]
    assert [s.tolist() for s in shingle_sets(long, 5)] == [shingle_sets([t], 5)[0].tolist() for t in long]
    assert len({tuple(shingle_sets(["y" * n], 5)[0].tolist()) for n in range(1000, 5200, 7)}) == 600


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[100:1100])
    s = sketching.fast_sketch(np.concatenate([a, b]), np.array([a.size, b.size]), 2000)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.04
    small = sketching.fast_sketch(pool[:1], np.array([1, 0]), 50)
    assert (small[0] != 2**64 - 1).all() and (small[1] == 2**64 - 1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(500, j) for j in range(501, 560)]
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90} and {got[i] for i in range(500, 560)} == {500}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(awkward).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1 and got[1]["kept"] and not got[3]["kept"]
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == got[6]["n_shingles"] == 0 and got[5]["kept"]
    assert got[8]["component_id"] == 7 and got[None]["component_id"] is None
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_family(spark):
    """A family whose members are linked in chains and straddle the threshold, against all pairs."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            t[j] = f"x{i}_{j}"
        texts.append(" ".join(t))
    sets = [shingle_set(t, 5) for t in texts]
    label = list(range(150))
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label))


def test_decontamination(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9"), (2, ""), (3, None), (None, "one two"), (4, "absent words only in the benchmark here")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(awkward, items).collect()}
    assert got[1]["_items"] == [1] and got[3]["_items"] == [1] and got[1]["_containment"] == 1.0
    assert got[7]["_items"] == [None] and got[8]["_items"] == [None] and got[9]["_items"] == [] and got[5]["_items"] == []
    in_blocks = decontamination.contamination(awkward.select("doc_id", "text"), items, block_bytes=30).collect()
    assert sorted((str(r["doc_id"]), r["_items"]) for r in in_blocks) == sorted((str(r["doc_id"]), r["_items"]) for r in decontamination.contamination(awkward, items).collect())
    assert decontamination.contamination(nothing, items).count() == 0
    assert all(r["_items"] == [] for r in decontamination.contamination(awkward, items.limit(0)).collect())


def test_short_items_in_long_documents_are_found(spark):
    rng = np.random.default_rng(3)
    docs, items = [], []
    for i in range(60):
        item = [f"i{i}_{j}" for j in range(int(rng.integers(5, 40)))]
        text = [f"d{rng.integers(0, 10**9)}" for _ in range(int(rng.integers(10, 8000)))]
        at = int(rng.integers(0, len(text)))
        docs.append((i, " ".join(text[:at] + item + text[at:])))
        items.append((i, " ".join(item)))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert all(r["_items"] == [r["doc_id"]] for r in got)


def arc(version, name, records):
    """An ARC file of (URL, date, type, block) rows, lengths declared as they are."""
    about = f"{version} 0 Org\n{' '.join(warc.ARC_FIELDS[version])}\n".encode()
    out = b""
    for url, date, kind, block in [(f"filedesc://{name}", "19960923142103", "text/plain", about), *records]:
        more = f" 200 - - 0 {name}" if version == 2 else ""
        out += f"{url} 1.2.3.4 {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"
    return out


ARC1 = arc(1, "a.arc", [("http://x/a b", "19960923142103", "text/html", b"HTTP/1.0 200 OK\r\n\r\n<p>hi\n\n")])
ARC2 = arc(2, "b.arc", [("dns:x", "199701010000", "text/dns", b"abcde")])


def test_arc_versions():
    first, page = list(warc.parse_arc(ARC1))
    assert first["described"] and page["URL"] == "http://x/a b" and page["block"].endswith(b"<p>hi\n\n")
    made = warc.synthesised(page, "a 1")
    assert made["record_type"] == "response" and made["date"] == "1996-09-23T14:21:03Z" and made["payload_digest"] == warc.sha1_base32(page["block"][19:])
    assert made["record_id"] == warc.synthesised(page, "a 1")["record_id"] != warc.synthesised(page, "a 2")["record_id"]
    described, record = list(warc.parse_arc(ARC2))
    assert record["block"] == b"abcde" and warc.synthesised(record, "b 1")["record_type"] == "resource" and warc.synthesised(described, "b 0")["record_type"] == "warcinfo"
    assert warc.iso_date("199701010000") == "1997-01-01T00:00:00Z"


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "http://c d", ""), (4, "http://e", None), (5, "http://f", "é\r\n\r\nWARC/1.1\r\n" * 5), (None, "http://g", "y"), (6, "http://h", "z" * 3_000_000), (7, "http://i", "q"), (7, "http://i", "q")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = warc.convert(frame).collect()
    assert len(got) == len(pages) and all(r["valid"] for r in got)
    by = {r["source_id"]: r for r in got}
    assert by[1]["record_type"] == "revisit" and by[2]["record_type"] == "response" and by[1]["refers_to_record"] == by[2]["record_id"]
    assert by[3]["record_type"] == "revisit" and by[4]["payload_bytes"] == 0 and by[6]["payload_bytes"] == 3_000_000
    assert sorted(r["record_type"] for r in got if r["source_id"] == 7) == ["response", "revisit"]
    assert by[5]["payload_digest"] == warc.sha1_base32(pages[4][2].encode())
    assert warc.convert(frame.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(content)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(awkward.select("doc_id", "text"))
    for r in token_counts.count_tokens(docs, content).collect():
        assert r["_n_tokens"] == count(r["text"]) and r["_n_bytes"] == len((r["text"] or "").encode())
    assert token_counts.count_tokens(nothing, content).count() == 0
    rng = np.random.default_rng(4)
    letters = list("ab eé' \n\t.,!stlrevmd1½日😀  <|>AB") + ["<|endoftext|>", "'re", "tion", "ing", " the", "internationalization"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(1500)] + ["x" * 9000, " " * 5000 + "y", "-" * 999]
    counter = token_counts.Counter(content, token_counts.char_classes(content))
    assert counter.counts(texts)[1].tolist() == [count(t) for t in texts]
    counter.transducer.most_states = 10  # the table starts anew at every batch
    assert counter.counts(texts[:300])[1].tolist() == [count(t) for t in texts[:300]]


def test_chunk_maps_compose_to_the_library_counts():
    """Texts of one piece, read in chunks that only the scan ties together; periodic ones never forget where they began."""
    import public_tokenizers
    from tokenizers import Tokenizer

    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(content)
    rng = np.random.default_rng(9)
    random = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60_000))
    texts = [random, "a" * 20_011, "ab" * 9_000 + "c", "-=" * 7_000, " " * 9_000, random[:7_000] + " " + random[:6_999], "ing" * 5_000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.Counter(content, token_counts.char_classes(content))
    assert counter.counts(texts)[1].tolist() == want
    machine = counter.transducer
    machine.most_states = 100
    data = np.frombuffer(random.encode(), np.uint8)
    starts = np.zeros(data.size, bool)
    starts[0] = True
    assert machine.emitted(data, starts, block=5_000).sum() == want[0]  # in blocks, with fresh tables at each
    assert len(machine.keys) < 12_000 and len(machine._apart) + len(machine._same) + len(machine._first) < 60_000


def test_prefix_scan_equals_reading_on():
    rng = np.random.default_rng(10)
    maps = rng.integers(0, 3, (3, 37))
    entries = np.repeat(np.arange(3)[:, None], 37, axis=1)
    constant = rng.random(37) < 0.1
    maps[:, constant] = maps[2, constant]
    state, want = 0, []
    for i in range(37):
        state = maps[state, i]
        want.append(state)
    assert token_counts._composed(entries, maps, constant).tolist() == want
    assert (token_counts._composed(entries[:1], maps[:1], np.zeros(37, bool))[:1] == maps[0, 0]).all()


def test_quality(spark, awkward, nothing):
    sf = DATA.replace("0.001", "0.01")
    got = registry.QUERIES["op2_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (held.predicted == held.quality).mean() > 0.93
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    voters = quality.fit(docs, quality.labelled_quality(spark, DATA))
    rows = quality.score(awkward, voters).collect()
    assert len(rows) == awkward.count() and all(0 <= r["_score"] <= 1 for r in rows) and quality.score(nothing, voters).count() == 0
    none = quality.fit(docs, quality.labelled_quality(spark, DATA).limit(0))
    assert {r["_score"] for r in quality.score(awkward, none).collect()} == {0.5}


def test_exact_cosine_votes_equal_brute_force():
    rng = np.random.default_rng(5)
    rows, labels = rng.normal(size=(80, 40)).astype(np.float32), rng.integers(0, 2, 80)
    voters = quality.Voters(rows, labels, dimensions=8, neighbours=5)
    test = rng.normal(size=(30, 40)).astype(np.float32)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit((test - voters.mean) * voters.weight @ voters.axes) @ unit((rows - voters.mean) * voters.weight @ voters.axes).T
    for got, c in zip(voters.scores(test, block=7), cosine, strict=True):
        near = np.argsort(-c)[:5]
        w = np.maximum(c[near], 1e-6) ** 2
        assert got == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)


def test_mixing(spark, awkward, nothing):
    sf = DATA.replace("0.001", "0.01")
    got = registry.QUERIES["op8_mixing"](spark, sf).toPandas()
    tokens = {d: (got.tokens * got[f"p_{d}"] * got.rate).sum() for d in ("clean", "low", "toxic")}
    for d, want in (("clean", 0.90), ("low", 0.06), ("toxic", 0.04)):
        assert tokens[d] / got.tokens.sum() == pytest.approx(want, rel=2e-3)
    assert (got.rate >= 0).all() and got.copies.sub(got.rate).abs().max() < 1
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    label = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "b").otherwise("a").alias("label"))
    model = mixing.fit_model(docs, label, ["a", "b"])
    members = mixing.posteriors(awkward, model)
    assert {r["_tokens"] for r in members.filter("doc_id = 8").collect()} == {2}
    for m in (members, mixing.posteriors(nothing, model)):
        assert mixing.with_rates(m, mixing.fit_rates(m, ["a", "b"], {"a": 0.9, "b": 0.1})).count() == m.count()


def test_projected_gradient_stays_nonnegative(spark):
    members = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0]), (3, 10, [0.5, 0.5])], "doc_id bigint, _tokens bigint, _domains array<double>")
    path = mixing.fit_rates(members, ["a", "b"], {"a": 1.0, "b": 0.0}, total=10.0, rounds=400, near=1e-3)
    rates = {r["doc_id"]: r["_rate"] for r in mixing.with_rates(members, path).collect()}
    assert min(rates.values()) >= 0 and rates[2] < 0.05 and rates[1] + 0.5 * rates[3] == pytest.approx(1.0, abs=0.05)


def dealt(spark, shares, rows=3000):
    """Members of three domains, 0.95 to 0.99 sure of their own."""
    rng = np.random.default_rng(8)
    own = rng.choice(3, rows, p=shares)
    sure = rng.uniform(0.95, 0.99, rows)
    q = np.repeat(((1 - sure) / 2)[:, None], 3, axis=1)
    q[np.arange(rows), own] = sure
    tokens = rng.integers(1, 800, rows).tolist()
    return spark.createDataFrame(list(zip(range(rows), tokens, q.tolist(), strict=True)), "doc_id bigint, _tokens bigint, _domains array<double>").cache()


@pytest.mark.parametrize("shares", [(0.34, 0.33, 0.33), (0.65, 0.02, 0.33), (0.99, 0.009, 0.001), (0.33, 0.66, 0.01), (0.01, 0.01, 0.98)])
def test_mixing_meets_far_targets(spark, shares):
    members, names = dealt(spark, shares), ["clean", "low", "toxic"]
    path = mixing.fit_rates(members, names, {"clean": 0.90, "low": 0.06, "toxic": 0.04})
    rows = mixing.with_rates(members, path).collect()
    got = sum(r["_rate"] * r["_tokens"] * np.array(r["_domains"]) for r in rows)
    assert got / sum(r["_tokens"] for r in rows) == pytest.approx([0.90, 0.06, 0.04], rel=2e-4)
    assert path.missed == [] and min(r["_rate"] for r in rows) >= 0


def test_mixing_names_missed_targets(spark):
    members = dealt(spark, (0.7, 0.3, 0.0)).withColumn("_domains", F.array(F.col("_domains")[0] + F.col("_domains")[2], F.col("_domains")[1], F.lit(0.0)))
    path = mixing.fit_rates(members, ["clean", "low", "toxic"], {"clean": 0.90, "low": 0.06, "toxic": 0.04})
    assert path.missed == ["toxic"] and path.have[:2] == pytest.approx(path.want[:2], rel=1e-4)
    out = registry.QUERIES["op8_mixing"](spark, DATA)
    assert out.schema["missed"].dataType.simpleString() == "array<string>" and {tuple(r["missed"]) for r in out.collect()} == {()}


def test_language(spark, awkward, nothing):
    sf = DATA.replace("0.001", "0.01")
    got = registry.QUERIES["op9_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    model, names = language_id.fit(spark.read.parquet(f"{DATA}/documents.parquet"), steps=30)
    rows = language_id.identify(awkward, model, names).collect()
    assert {r["_lang"] for r in rows if r["doc_id"] in (4, 5, 6, 10)} == {"und"} and all(r["_lang"] in names for r in rows if r["doc_id"] in (1, 9, 13))
    assert len(rows) == awkward.count() and language_id.identify(nothing, model, names).count() == 0
    assert language_id.fit(nothing) [1] == []


def test_network_gradients():
    rng = np.random.default_rng(6)
    model = language_id.BiGRU(3, hidden=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    data, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        f, _ = model._forward("f", data)
        b, _ = model._forward("b", data)
        logits = f @ model.p["fv"] + b @ model.p["bv"] + model.p["c"]
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return -logits[:, np.arange(5), y].mean(), logits

    f, kf = model._forward("f", data)
    b, kb = model._forward("b", data)
    q = np.exp(loss()[1])
    q[:, np.arange(5), y] -= 1
    q /= q.shape[0] * 5
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    for d, kept in (("f", kf), ("b", kb)):
        model._backward(d, data, kept, q @ model.p[d + "v"].T, grads)
    for name in ("fuz", "bun", "fxr", "bxz"):
        where = (int(data[2, 1]), 2) if "x" in name else (1, 2)
        kept, step = model.p[name][where], 1e-3
        model.p[name][where] = kept + step
        up = loss()[0]
        model.p[name][where] = kept - step
        down = loss()[0]
        model.p[name][where] = kept
        assert grads[name][where] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5)


def test_inference_equals_the_trained_network():
    """Texts of any length, alone and in company, against the forward pass of training on exactly their bytes."""
    rng = np.random.default_rng(11)
    model = language_id.BiGRU(3, hidden=8)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 2, 30, 63, 64, 65, 127, 128, 200, 7, 500)]

    def logits(data):
        data = np.frombuffer(data, np.uint8)[:, None]
        return (model._forward("f", data)[0] @ model.p["fv"] + model._forward("b", data)[0] @ model.p["bv"] + model.p["c"])[:, 0]

    ragged = np.zeros((65, 6), np.uint8)
    for i, t in enumerate(texts[:6]):
        ragged[: len(t), i] = np.frombuffer(t, np.uint8)
        ragged[len(t) :, i] = 77
    got = model.position_logits(ragged, np.array([len(t) for t in texts[:6]]))
    for i, t in enumerate(texts[:6]):
        assert got[: len(t), i] == pytest.approx(logits(t), abs=1e-5)
    window = 64
    want = []
    for t in texts:
        starts = [0] if len(t) < window else [min(a, len(t) - window) for a in range(0, len(t), window)]
        total, seen = np.zeros(3), 0
        for a in starts:
            x = logits(t[a : a + window])
            x = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
            total += x[seen - a :].sum(axis=0)
            seen = min(len(t), a + window)
        mean = np.exp(total / len(t))
        want.append(mean / mean.sum())
    assert model.pooled(texts, window, lanes=3) == pytest.approx(np.array(want), abs=1e-5)


def test_short_texts_keep_their_language(spark):
    sf = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model, names = language_id.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))
    held = [(r["text"], r["lang"]) for r in docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and lang is not null and length(text) > 200").collect()]
    for size, least in ((63, 0.95), (40, 0.93), (30, 0.9)):
        q = model.pooled([t.encode()[:size] for t, _ in held], 64)
        assert np.mean([names[k] == lang for k, (_, lang) in zip(q.argmax(axis=1), held, strict=True)]) >= least


def test_line_dedup_of_awkward_rows(awkward, nothing):
    got = {r["doc_id"]: r for r in line_dedup.without_lines(awkward).collect()}
    assert got[11]["_removed"] == [1] and got[11]["_lines"] == 5
    assert got[12]["_removed"] == [0] and got[12]["text"] == "zeta eta"
    assert got[5]["text"] is None and got[5]["_removed"] == [] and got[4]["_removed"] == [] and got[6]["_removed"] == []
    assert got[7]["_removed"] == [] and got[2]["_removed"] == [0] and got[3]["_removed"] == [0] and got[8]["_removed"] == [0]
    assert len(line_dedup.without_lines(awkward).collect()) == awkward.count() and line_dedup.without_lines(nothing).count() == 0


def test_clashing_column_names(spark):
    """Columns of the input with names of helpers or results: helpers leave them alone, results replace them."""
    names = ["_key", "_hash", "_gone_key", "_h", "_bucket", "_at", "_near", "_block", "_order_id", "_tokens", "_domains", "_items", "_lang", "_Score", "_removed", "_slot"]
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of line "), F.col("id") % 3).alias("text"), *[F.lit("x").alias(n) for n in names])
    sharded = sharding.shard(docs, 3)
    assert len(check_shards(sharded.collect(), 3)) == 3 and sharded.columns.count("_slot") == 1 and "_bucket" in sharded.columns and "_at" in sharded.columns
    lines = line_dedup.without_lines(docs)
    assert {r["_key"] for r in lines.collect()} == {"x"} and sorted(len(r["_removed"]) for r in lines.collect()) == [0] * 3 + [1] * 27
    items = spark.createDataFrame([(1, "some words of line 1")], "item_id bigint, text string")
    for block in (1 << 20, 4):
        found = decontamination.contamination(docs, items, block_bytes=block)
        assert sum(len(r["_items"]) for r in found.collect()) == 10 and found.columns.count("_items") == 1
    none = language_id.BiGRU(1), []
    named = language_id.identify(docs, *none)
    assert {r["_lang"] for r in named.collect()} == {"und"} and [c.lower() for c in named.columns].count("_score") == 1
    labels = spark.createDataFrame([(1, 1.0)], "doc_id bigint, label double")
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).count() == 30
    assert near_dedup.near_duplicates(docs).filter("kept").count() == 3 and exact_dedup.exact_dedup(docs).filter("kept").count() == 3


def test_ids_with_several_texts_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(7, a), (7, b), (1, a + " z"), (2, b + " z")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()} == {(7, 1), (1, 1), (2, 1)}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [P.keep_quality(spark, docs, DATA).toPandas()]
    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    frame = spark.createDataFrame(kept[0], docs.schema)
    sets = {r.doc_id: shingle_set(r.text, 5) for r in kept[0].itertuples()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    unique = {i for i in sets if label[i] == i}
    assert {r["doc_id"] for r in stages["near_duplicates"](spark, frame, DATA).collect()} == unique
    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i in sets if not any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in items)}
    after = stages["decontamination"](spark, frame, DATA)
    assert {r["doc_id"] for r in after.collect()} == clean and after.columns == docs.columns
    mixed = stages["mixing"](spark, frame, DATA)
    assert mixed.columns == docs.columns and mixed.count() > 0.8 * len(sets)
    out = P.run(spark, DATA).toPandas()
    # stages see only what their predecessors kept, so a document of a group whose smallest went earlier may stay
    assert set(out.doc_id) <= clean and len(set(out.doc_id) & unique) > 0.9 * len(set(out.doc_id)) and out.shard.between(0, 23).all()
    assert out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_pipeline_keeps_what_its_stages_decide(spark):
    """Rows of the whole run, with multiplicity, against each stage's decisions on its own input."""
    import corpus_pipeline as P

    from dramaturg.llm._features import features

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    voters = quality.fit(docs, quality.labelled_quality(spark, DATA))
    ids = [i for i, s in zip(texts, voters.scores(features(list(texts.values()))), strict=True) if s >= 0.5]
    sets = {i: shingle_set(texts[i], 5) for i in ids}
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    ids = [i for i in ids if label[i] == i and not any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in items)]
    left = docs.filter(F.col("doc_id").isin(ids)).select("doc_id", "text")
    toxic = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("label"))
    model = mixing.fit_model(left, toxic, ["clean", "toxic"])
    q = model.posteriors(features([texts[i] for i in ids], mixing.WORD_TERMS)).astype(np.float64)
    n = np.array([len(words(texts[i])) for i in ids])
    path = mixing.fit_rates(mixing.posteriors(left, model), ["clean", "toxic"], P.TARGETS, kept="clean")
    rates = mixing.rates_of(q, path)
    # the clean domain keeps its tokens
    assert (n * rates) @ q == pytest.approx(np.array([0.98, 0.02]) / 0.98 * (n @ q)[0], rel=1e-3)
    draws = {r["doc_id"]: r["d"] for r in left.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / (1 << 30)).alias("d")).collect()}
    copies = collections.Counter({i: int(r + draws[i]) for i, r in zip(ids, rates, strict=True)})
    out = P.run(spark, DATA).toPandas()
    assert len(texts) == docs.count() and collections.Counter(out.doc_id.tolist()) == +copies
    assert out.shard.between(0, 23).all() and all(texts[r.doc_id] == r.text for r in out.itertuples())
    by = [sum(len((r.text or "").encode()) + 8 for r in out[out.shard == s].itertuples()) for s in range(24)]
    assert max(by) - min(by) <= 2 * max(len((t or "").encode()) + 8 for t in texts.values())


@pytest.mark.parametrize(("crowd", "dense"), [(2, 2), (2, 60), (1000, 40), (1000, 1000)])
def test_lines_of_dense_tokens_meet_by_pairs(spark, monkeypatch, crowd, dense):
    """Few words make every token crowded; families of near copies and unrelated lines against brute force."""
    import random

    monkeypatch.setattr(line_dedup, "_CROWD", crowd)
    monkeypatch.setattr(line_dedup, "_DENSE", dense)
    draw, vocabulary = random.Random(4), [f"w{i}" for i in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(4):
            line = draw.sample(vocabulary, draw.randint(1, 14))
            lines.append(" ".join(line))
            if draw.random() < 0.5:
                line[draw.randrange(len(line))] = draw.choice(vocabulary)
                lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["_removed"] for r in line_dedup.without_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    flat = [(i, p, frozenset(line.split())) for i, t in rows for p, line in enumerate(t.split("\n"))]
    want = {i: [] for i, _ in rows}
    for k, (i, p, tokens) in enumerate(flat):
        if any(10 * len(tokens & before) >= 8 * len(tokens | before) for _, _, before in flat[:k]):
            want[i].append(p)
    assert got == want and sum(map(len, want.values())) > 100


def test_lines_meet_by_token_and_size(spark, monkeypatch):
    """Lines of one vocabulary and very different sizes, and a family of near copies: the joins bring together those of like size only."""
    import random

    draw, vocabulary, meetings = random.Random(5), [f"w{i}" for i in range(300)], []
    rows = [(i, " ".join(draw.sample(vocabulary, 10 + i % 150))) for i in range(300)]
    rows += [(300 + i, " ".join([f"b{k}" if k != i else f"own{i}" for k in range(40)])) for i in range(40)]
    joined = line_dedup._joined
    monkeypatch.setattr(line_dedup, "_joined", lambda x, y, *rest, **more: meetings.append(x.select("token").join(y.select("token"), "token").count()) or joined(x, y, *rest, **more))
    got = {r["doc_id"]: r["_removed"] for r in line_dedup.without_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [frozenset(t.split()) for _, t in rows]
    want = {i: [0] if any(10 * len(s & t) >= 8 * len(s | t) for t in sets[:i]) else [] for i, s in enumerate(sets)}
    assert got == want and sum(map(len, want.values())) >= 39
    assert sum(meetings) < 100_000, meetings


def test_line_index_stays_in_generated_code(spark, monkeypatch):
    """Each side of a slice's join reads the sets once, and lists dense tokens' pairs without lambdas, which leave generated code."""
    monkeypatch.setattr(line_dedup, "_DENSE", 2)
    joined, plans = line_dedup._joined, []

    def seen(x, y, *rest, by_size, **more):
        if by_size:
            plans.extend(side._jdf.queryExecution().optimizedPlan().toString() for side in (x, y))
        return joined(x, y, *rest, by_size=by_size, **more)

    monkeypatch.setattr(line_dedup, "_joined", seen)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b x y z")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["_removed"] for r in line_dedup.without_lines(docs).collect()} == {1: [], 2: [0], 3: []}
    assert plans and all("lambda" not in p and p.count("Relation [") == 1 for p in plans)


def test_first_lines_leave_lists_of_tokens_in_place(spark):
    """One line of each token set, the first of them, also where a row repeats id and text; lists of tokens are neither sorted nor shuffled."""
    rows = [(1, 1, 2, 5, 7, 10), (1, 1, 2, 4, 9, 11), (1, 1, 2, 4, 8, 12), (1, 1, 2, 4, 8, 13), (2, 2, 2, 6, 1, 14), (3, 3, 1, 2, 2, 15), (3, 3, 1, 3, 1, 16)]
    lines = spark.createDataFrame(rows, "s0 bigint, s1 bigint, n int, key bigint, at bigint, row bigint").withColumn("tokens", F.array("s0", "s1"))
    first = line_dedup._first_lines(lines)
    assert sorted((r["key"], r["at"]) for r in first.collect()) == [(2, 2), (4, 8), (6, 1)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert first.columns == lines.columns and "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan
    texts = [(1, "a b c d e f"), (2, "a\x0bb\tc\x0cd\re f"), (3, "a b\x0bc")]
    got = line_dedup.without_lines(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["_removed"] for r in got.collect()} == {1: [], 2: [0], 3: []}
