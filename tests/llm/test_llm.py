"""The operators of the subpackage against brute-force versions, and their defined results for odd input."""

import hashlib
import io
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge.llm import ann, chat_format, common, decontaminate, lang_id, mixing, sharding, simhash, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = [f"w{i}" for i in range(60)]


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(W, n))


ODD = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "  \t\x0b ", "en", "a", 5), (3, "one", None, "b", 3), (4, "x" * 5000 + " " + "long " * 3000, "en", "b", 1), (None, words(1, 30), "fr", None, 1), (5, words(1, 30), "fr", "é", 1), (5, words(1, 30), "fr", "é", 1), (6, words(1, 30) + " tail", "fr", "z", 1)]


@pytest.fixture
def odd(spark):
    # further columns, with names that operators use themselves
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("own"), "fp": F.lit("own"), "component_id": F.lit(7), "shard": F.lit("s"), "score": F.lit(1), "t": F.lit("own"), "before": F.lit("own"), "range": F.lit("own"), "bucket": F.lit("own"), "_source": F.lit("own"), "h": F.lit("own"), "carry": F.lit("own"), "text_hash": F.lit("own")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def removed(rows, k=13):
    """(n_words, n_removed, sha256) of each row, by brute force."""
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, w in split:
        for i in range(len(w) - k + 1):
            key = b" ".join(w[i : i + k])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - k + 1) if first[b" ".join(w[i : i + k])] < order(d) for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, odd, none):
    got = sorted(map(tuple, substring_dedup.remove_repeated_windows(odd).drop("kept_text").collect()), key=str)
    assert got == removed(ODD)
    base = words(3, 200)
    rows = [(i, " ".join([words(i, 20), " ".join(base.split()[i : i + 60]), words(i + 50, 20)]), "en", "a", 1) for i in range(40)] + [(99, base + " " + base, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(map(tuple, substring_dedup.remove_repeated_windows(docs).drop("kept_text").collect()), key=str) == removed(rows)
    assert substring_dedup.remove_repeated_windows(none).count() == 0


def test_common_phrases_and_passages(spark):
    """A phrase that all texts have doesn't draw windows to one bucket, and a passage in all of them is sent about once a task; results are as ever."""
    phrase, passage = "all rights reserved", words(5, 40)
    rows = [(i, f"{words(i, 25)} {phrase} {words(i + 900, 25)}" + (f" {passage} {words(i + 2000, 9)}" if i % 3 == 0 else ""), "en", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    common = substring_dedup.common_strings(docs, "text", 3)
    assert len(common) >= 35
    assert sorted(map(tuple, substring_dedup.remove_repeated_windows(docs).drop("kept_text").collect()), key=str) == removed(rows)
    split = [r[1].encode().split() for r in rows]
    own = lambda c: substring_dedup.super_kmers(split, 13, 3, c).h
    most = lambda h: np.unique(h, return_counts=True)[1].max()
    assert most(own(common)) <= most(own(common[:0]))
    sent, again = substring_dedup._Sent(), 0
    for at in range(0, 400, 40):
        found = substring_dedup.super_kmers(split[at : at + 40], 13, 3, common)
        doc = found.owner + at
        kept, _, repeated = substring_dedup._merge(found, doc)
        again += sent.known(found, doc, kept).sum()
        sent.add(repeated)
    assert again > 0


def test_bucket_keys(spark):
    for buckets, partitions in ((51, 51), (112, 51), (211, 211), (12, 12), (3000, 1000), (4, 4)):
        keys = substring_dedup.bucket_keys(buckets, partitions).tolist()
        rows = spark.createDataFrame([(k,) for k in keys], "k int").groupBy(F.pmod(F.hash("k"), F.lit(partitions)).alias("p")).count().collect()
        assert len(set(keys)) == buckets and {r["count"] for r in rows} <= {buckets // partitions, -(-buckets // partitions)} and len(rows) == partitions


def test_windows_in_passes(monkeypatch):
    """Several passes, and windows whose hashes collide, give the same windows."""
    rows = [(d, words(d % 3, 60).encode()) for d in range(6)]
    raw = b"".join(t + b"\n" for _, t in rows)
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    run = lambda: sorted((int(r), int(p)) for a, b in substring_dedup.repeated_windows(raw, np.arange(6), np.arange(6), starts, ends, 13) for r, p in zip(a, b))
    whole = run()
    assert whole == [(r, p) for r in (3, 4, 5) for p in range(48)]
    monkeypatch.setattr(substring_dedup, "_PASS", 200)
    monkeypatch.setattr(substring_dedup, "_CHUNK", 150)
    assert run() == whole
    real = substring_dedup._windows
    monkeypatch.setattr(substring_dedup, "_windows", lambda *a: ((x[0] % np.uint64(3), *x[1:]) for x in real(*a)))
    monkeypatch.setattr(substring_dedup, "_PASS", 1 << 30)
    assert run() == whole


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("radius", "segments", "cap"), [(2, 2, 1024), (2, 2, 1), (3, 2, 1), (3, 3, 1024)])
def test_simhash_links(spark, radius, segments, cap):
    rng = np.random.default_rng(radius + cap)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = {i: centres[i % 4] ^ int(sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 5))))) for i in range(60)}
    nodes = spark.createDataFrame([(x,) for x in set(fps.values())], "fp long")
    edges = simhash.links(nodes, radius, segments, cap)
    roots = {r.node: r.root for r in common.connected_components(edges).collect()}
    group = lambda label: {frozenset(i for i in fps if label(i) == label(j)) for j in fps}
    want = brute_components(fps, radius)
    assert group(lambda i: roots.get(fps[i], fps[i])) == group(lambda i: want[i])


def test_simhash_groups(spark, odd, none):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(odd).collect()]
    found = dict(got)
    assert len(got) == len(ODD) and found[0] == found[1] == found[2] == 0 and found[5] == found[None] == 5
    assert simhash.near_duplicate_groups(none).count() == 0 and simhash.verified_groups(none).count() == 0
    groups = [(r.doc_id, r.component_id, r.is_first) for r in simhash.verified_groups(odd).collect()]
    assert sorted(groups, key=str) == sorted([(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (None, 5, False)], key=str)


def test_fingerprints(spark):
    """The bits of the fingerprint against a direct count over all shingles."""
    import xxhash

    texts = [None, "", "Ab", "one TWO", words(7, 3), words(8, 40).upper(), "a b a b a b a b", "É\u00a0x\x0by z\x1cw", words(9, 900)]
    want = {}
    for i, t in enumerate(texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(own[j : j + 3]) for j in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()} == want


def near_copies(n, size=80):
    """Copies of a text with 0 to 6 replaced words each, and some other texts."""
    rng, base, rows = np.random.default_rng(8), [f"b{i}" for i in range(size)], []
    for d in range(n):
        own = list(base)
        for p in rng.choice(size, d % 7, replace=False):
            own[p] = f"x{rng.integers(1000)}"
        rows.append((d, " ".join(own) if d % 5 else words(d, size)))
    return rows


def shingled(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_odd_sketches(spark):
    rows = near_copies(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = simhash.odd_sketches(docs, "doc_id", "text", 5)
    assert {r.node: r["size"] for r in sketches.collect()} == {d: len(shingled(t)) for d, t in rows}
    other = sketches.select(F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch"))
    passed = {(r.node, r.other) for r in sketches.join(other, F.col("node") < F.col("other")).where(simhash._may_be_similar(0.8)).collect()}
    alike = {(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if len(shingled(s) & shingled(t)) >= 0.8 * len(shingled(s) | shingled(t))}
    assert alike and alike <= passed and len(passed - alike) < 0.1 * 60 * 59 / 2


def test_verified_groups_in_large_buckets(spark):
    """Buckets that hold a large group give the components that checking all their pairs gives, and only true links."""
    rows = near_copies(90)
    docs = spark.createDataFrame([*rows, *((d + 200, t) for d, t in rows[:20])], "doc_id long, text string")
    runs = [{r.doc_id: r.component_id for r in simhash.verified_groups(docs, bucket_cap=cap).collect()} for cap in (2, 1 << 20)]
    assert runs[0] == runs[1] and len(set(runs[0].values())) < 80 and all(runs[0][d + 200] == runs[0][d] for d in range(20))
    texts = dict(rows)
    for d, c in runs[0].items():  # each member of a group has a partner in it
        own = shingled(texts[d % 200])
        mates = [texts[x % 200] for x, y in runs[0].items() if y == c and x != d]
        assert not mates or any(len(own & shingled(t)) >= 0.8 * len(own | shingled(t)) for t in mates)


def edits(n):
    """(kind, text, edited text): one edit of each kind of n texts."""
    rng = np.random.default_rng(12)
    new = lambda k: [f"n{x}" for x in rng.integers(1 << 40, size=k)]
    for _ in range(n):
        base = [f"v{x}" for x in rng.integers(1 << 40, size=int(rng.integers(60, 300)))]
        for share in (0.9, 0.85, 0.82):
            own = new(len(base))
            cut = math.ceil(share * len(own))
            yield f"cut {share}", own, own[:cut]
            own = new(cut)
            yield f"extended {share}", own, own + new(len(base) - cut)
        own = new(len(base))
        yield "inserted", own, own[:30] + new(len(own) // 8) + own[30:]
        own = new(len(base))
        at = set(rng.choice(len(own), len(own) // 60, replace=False).tolist())
        yield "replaced", own, [f"r{i}" if i in at else w for i, w in enumerate(own)]


def test_verified_groups_find_every_edit(spark):
    cases = [(kind, " ".join(a), " ".join(b)) for kind, a, b in edits(8)]
    similar = [len(shingled(a) & shingled(b)) >= 0.8 * len(shingled(a) | shingled(b)) for _, a, b in cases]
    rows = [(2 * i + j, t) for i, (_, *both) in enumerate(cases) for j, t in enumerate(both)]
    found = {r.doc_id: r.component_id for r in simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(similar) > 50
    assert [found[2 * i + 1] == 2 * i for i in range(len(cases))] == similar


def test_verified_groups_by_fingerprints(spark, monkeypatch):
    """Without any prefix, the segment tables find texts with equal or near fingerprints, and the exact check decides on them."""
    rows, line = [], [f"c{i % 3}" for i in range(150)]
    for d in range(0, 40, 2):
        own = words(d, 900).split()
        rows += [(d, " ".join(own)), (d + 1, " ".join([*own[:-1], "other"]))]
        rows += [(100 + d, " ".join([*line, *words(100 + d, 20).split()]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = simhash.prefix_rows
    monkeypatch.setattr(simhash, "prefix_rows", lambda *args: plain(*args).withColumn("keys", F.array().cast("array<long>")))
    found = {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()}
    fps = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    near = [d for d in range(0, 40, 2) if bin(fps[d] ^ fps[d + 1]).count("1") <= 2]
    assert len(near) > 10 and all(found[d] == found[d + 1] == d for d in near)
    assert len({fps[100 + d] for d in range(0, 40, 2)}) < 20 and all(found[100 + d] == 100 + d for d in range(0, 40, 2))


def test_verified_groups_with_common_passages(spark):
    """Shingles that many texts share decide only the order of the prefixes."""
    rng, line = np.random.default_rng(5), [f"c{i}" for i in range(30)]
    rows = []
    for d in range(80):
        own = [f"o{x}" for x in rng.integers(1 << 40, size=int(rng.integers(8, 40)))]
        rows += [(2 * d, " ".join(line + own)), (2 * d + 1, " ".join(own[: len(own) // 2] + line))]
    want = brute_components_of_texts(dict(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.common_shingles(docs, "doc_id", "text", 5)
    for cap in (4, 1 << 20):
        assert {r.doc_id: r.component_id for r in simhash.verified_groups(docs, bucket_cap=cap).collect()} == want


def test_wide_sketches(spark):
    """Sketches of long texts pass all similar pairs, whatever their lengths, and reject others."""
    rng, rows = np.random.default_rng(6), []
    base = [f"b{x}" for x in rng.integers(1 << 40, size=4300)]
    for d, n in enumerate([3500, 3800, 4090, 4110, 4200, 4300]):
        rows += [(d, " ".join(base[:n])), (d + 100, " ".join(base[:1500] + [f"n{d}x{i}" for i in range(n - 1500)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = simhash.prefix_rows(docs, "doc_id", "text", 5, 0.8, []).select(F.col("doc_id").alias("node"), "size", "wide").cache()
    other = own.select(F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("wide").alias("other_wide"))
    passed = {(r.node, r.other) for r in own.join(other, F.col("node") < F.col("other")).where(simhash._wide_may_be_similar(0.8)).collect()}
    sets = {d: shingled(t) for d, t in rows}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {len(r.wide) for r in own.collect()} == {32, 64} and alike and passed == alike


def brute_components_of_texts(texts):
    sets = {d: shingled(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_sharding(spark, odd, none):
    got = sharding.shard_by_bytes(odd, 3).collect()
    assert len(got) == len(ODD) and sum(r["size"] for r in got) == sum(len((r[1] or "").encode()) + 1 for r in ODD)
    docs = spark.createDataFrame([(i, words(i % 50 if i % 3 else 0, 40), "en", "a", 1) for i in range(900)], DOCS)
    rows = sharding.shard_by_bytes(docs, 8, carry=["doc_id"], ranges=16, sample=500).collect()
    by = {s: [r for r in rows if r["shard"] == s] for s in range(8)}
    assert sorted(r.doc_id for r in rows) == list(range(900))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) * 8 / sum(r["size"] for r in rows) - 1) < 0.05
    assert sharding.shard_by_bytes(none, 8).count() == 0


def test_sharding_by_hand(spark):
    """Shards, slots and checksums against one walk along the line of bytes in the operator's order; hot texts and hot rows are cut, small groups are whole."""
    import zlib

    rows = [(i, words(i, 1 + i % 40)) for i in range(700)] + [(1000 + i, "hot text " * 5) for i in range(900)] + [(5000, "the same row") for _ in range(600)] + [(None, None), (None, ""), (6000, "long " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("slot", F.lit("own"))
    for ranges in (1, 8, 64):
        got = sharding.shard_by_bytes(docs, 8, ranges=ranges, sample=60).select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t in rows)
        assert all(r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
        total, at, group = sum(r["size"] for r in got), 0, {}
        for r in got:
            group.setdefault(r.h, []).append(r)
        order = sorted(got, key=lambda r: (r.h, -(1 << 63) if r.doc_id is None else r.doc_id))
        place = {}
        for r in order:
            place[id(r)], at = at, at + r["size"]
        for own in group.values():
            size = sum(r["size"] for r in own)
            start = min(place[id(r)] for r in own)
            if size <= 0.01 * total / 8:
                assert {r.shard for r in own} == {int((start + size / 2) * 8 / total)}
        for s in range(8):
            own = [r for r in got if r.shard == s]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / 8) <= 0.01 * total / 8 + 10_001
        spans = [(min(place[id(r)] for r in got if r.shard == s), s) for s in range(8)]
        assert spans == sorted(spans)


def test_overfull_ranges(spark):
    """Ranges that a poor sample leaves overfull are subdivided until they hold at most twice the even size, down to single rows."""
    keys = spark.createDataFrame([(i // 400, 0, i, 10) for i in range(4000)], "h long, i long, r long, size long")
    even = 40_000 / 32
    poor = sharding.sampled_splitters(keys, 40_000, 32, 8, 1)
    worst = lambda cuts: keys.groupBy(sharding._below(cuts).alias("x")).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert worst(poor) > 2 * even >= worst(sharding.measured_splitters(keys, 40_000, 32, 8, 1))


def test_mixing_by_hand(spark):
    """The taken words of every row against the blocks that cover it, one by one; null and equal ids spread over buckets."""
    rows = [(None if i % 3 == 0 else 7, words(i, 1 + i % 50), ["a", "b", None][i % 3 if i < 300 else 0]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit("own"), "bucket": F.lit("own"), "size": F.lit("own")})
    taken = mixing._taken(docs, ["doc_id", "text"], False, "doc_id", "text", "source", mixing.WEIGHTS, 1.5, 2.0, 4000, 3, 16).collect()
    plans = mixing.plan_sources([(s, sum(len(t.split()) for _, t, x in rows if x == s)) for s in ("a", "b", None)], blocks=4000)
    assert len({r.bucket for r in taken}) > 20
    for ix, p in enumerate(plans):
        own = sorted((r for r in taken if r.ix == ix), key=lambda r: (r.bucket, r.by, r.h))
        counts = [p.quota // p.blocks + ((b * p.step + p.shift) % p.blocks < p.quota % p.blocks) for b in range(p.blocks)]
        bounds = [-(-b * p.size // p.blocks) for b in range(p.blocks + 1)]
        per_word = [counts[b] for b in range(p.blocks) for _ in range(bounds[b + 1] - bounds[b])]
        at = 0
        for r in own:
            assert r.taken == sum(per_word[at : at + r["size"]]) and r.source_size == p.size
            at += r["size"]
        assert at == p.size and abs(sum(r.taken for r in own) - p.target) <= 0.01 * p.target + 1


def test_mixing(spark, odd, none):
    got = {(r.doc_id, r["size"]): r for r in mixing.mix(odd).collect()}
    assert got[0, 0].taken == 0 and all(0 <= r.taken <= 2 * r["size"] for r in got.values())
    assert mixing.mix(none).count() == 0
    docs = spark.createDataFrame([(i, words(i, 1 + i % 90), "en", None if i % 7 == 0 else f"s{i % 4}", 1) for i in range(600)], DOCS)
    rows = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 5
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), carry=["doc_id"]).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_small_sources(spark):
    """A source far smaller than the others is mixed to its target whatever the width of their blocks."""
    small = [2000, 5000, 10_000, 13_000, 20_000, 30_000, 1, 77]
    plans = mixing.plan_sources([(f"s{i:02}", n) for i, n in enumerate([*small, 3_000_000_000, 1_600_000_000])])
    for p in plans:
        assert abs(p.quota * p.size / p.blocks - p.target) <= 0.002 * p.target + 0.5
    quotas = mixing.shard_quotas(plans, 8)
    assert [sum(q) for q in zip(*quotas)] == [p.quota for p in plans] and all(x >= 0 for q in quotas for x in q)
    docs = spark.createDataFrame([(i, words(i, 100), "en", "small" if i < 3 else f"t{i % 2}", 1) for i in range(400)], DOCS)
    rows = mixing.mix(docs, blocks=64, carry=["source"]).where("source = 'small'").collect()
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.01 * rows[0].target


def test_materialise(spark):
    """Sources' words come near their targets when all documents are much longer than a block."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, words(i, 200 + 7 * (i % 40)), "en", f"s{i % 4}", 1) for i in range(600)], DOCS)
    docs = docs.unionByName(spark.createDataFrame([(1000, None, "en", "s0", 0)], DOCS))
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    rows = corpus_pipeline.mix(spark, docs, "").collect()
    got, copies = dict.fromkeys(target, 0), {}
    for r in rows:
        got[r.source] += len((r.text or "").split())
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies[1000] == 1 and max(copies.values()) == 2
    for s, t in target.items():
        assert abs(got[s] - t) <= 0.03 * t
    again = corpus_pipeline.mix(spark, docs.repartition(7), "").collect()
    assert sorted(r.doc_id for r in again) == sorted(r.doc_id for r in rows)


def test_sainte_lague():
    def slow(weights, seats):
        out = [0] * len(weights)
        for _ in range(seats):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
            out[best] += 1
        return out

    for weights, seats in (([5.0, 2.0, 1.0], 37), ([1.0, 1.0, 1.0], 4), ([0.0, 3.0], 5), ([7.0], 3)):
        assert mixing.sainte_lague(weights, seats) == slow(weights, seats)
    plans = mixing.plan_sources([("b", 900), ("a", 100), (None, 50)], blocks=500)
    assert [p.source for p in plans] == ["a", "b", None]
    quotas = mixing.shard_quotas(plans, 4)
    assert [sum(q) for q in zip(*quotas)] == [p.quota for p in plans] and all(x >= 0 for q in quotas for x in q)


def test_language(spark, odd, none):
    texts = [(f"{a} {words(i, 5)} {b}", lang) for i in range(30) for lang, a, b in (("en", "the thing", "ation"), ("de", "der schön", "ung"))]
    model = lang_id.fit(texts, bits=12, epochs=6)
    got = lang_id.predict(odd, model, carry=("doc_id", "size")).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2}
    assert lang_id.identify(none).count() == 0
    assert {r.lang_pred for r in lang_id.identify(spark.createDataFrame([(1, "abc", None, "a", 1)], DOCS)).collect()} == {"und"}


def test_language_accuracy(spark):
    """Held-out texts of the small tables, whole and joined from two languages; labels of held-out rows have no say."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(docs, carry=("doc_id", "lang", "text")).where("held_out").collect()
    right = [r.lang_pred == r.lang for r in rows]
    assert len(right) > 200 and sum(right) / len(right) >= 0.99
    flipped = docs.withColumn("lang", F.when(lang_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(flipped).where("held_out").collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}
    pick = {lang: max((r.text for r in rows if r.lang == lang and r.lang_pred == lang and len(r.text) < 3000), key=len) for lang in ("en", "de", "fr", "es")}
    mixed = spark.createDataFrame([(i, f"{pick[a]} {pick[b]}", None) for i, (a, b) in enumerate(itertools.permutations(pick, 2))], "doc_id long, text string, lang string")
    found = lang_id.predict(mixed, lang_id.fit(lang_id.labelled_sample(docs, "text", "lang", 100, 20_000))).collect()
    assert all(r.n_switches >= 1 and r.score < 0.95 for r in found)


def label_all(model, texts):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    for part in lang_id._label(model, "text")(iter([batch])):
        yield from zip(*(part.column(c).to_pylist() for c in ("lang_pred", "score", "n_letter_runs", "n_switches")))


def test_labelling_memory():
    """What labelling takes beside its batch follows neither the batch's size nor the number or length of its words."""
    import tracemalloc

    model = lang_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20, bits=10, epochs=2)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    many = [" ".join(map("".join, letters[rng.integers(26, size=(250, 7))].tolist())) for _ in range(2_000)]
    long = ["".join(letters[rng.integers(26, size=200_000)]) for _ in range(100)]
    for texts, n in ((many, 250), (long, 1)):
        tracemalloc.start()
        assert sum(r[2] == n for r in label_all(model, texts)) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 72 << 20


def test_labels_by_any_slices(monkeypatch):
    """Slices and forgotten words have no say: each text has the labels that it has by itself."""
    model = lang_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 20, bits=10, epochs=4)
    texts = [t and f"the {t} katze le {words(i, 30)} der hund" for i, t in enumerate(["cat", "", None, "chien et", "12"] * 30)]
    want = [next(label_all(model, [t])) for t in texts]
    assert len({r[0] for r in want}) > 1
    for size, n_kept, n_letters in ((1, 1, 1 << 20), (300, 40, 1 << 20), (300, 1 << 20, 100), (1 << 20, 1 << 20, 1 << 20)):
        monkeypatch.setattr(lang_id, "_SLICE", size)
        monkeypatch.setattr(lang_id, "_KEPT_WORDS", n_kept)
        monkeypatch.setattr(lang_id, "_KEPT_LETTERS", n_letters)
        got = list(label_all(model, texts))
        assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in want]
        assert np.allclose([r[1] for r in got], [r[1] for r in want], rtol=0, atol=1e-9)


def test_local_rows(spark):
    """They need no Python worker of an executor."""
    rows = [("a", 1, -(1 << 63), 0.5), (None, None, (1 << 63) - 1, None)]
    made = common.local_rows(spark, rows, "s string, i int, l long, d double")
    assert made.dtypes == [("s", "string"), ("i", "int"), ("l", "bigint"), ("d", "double")] and [tuple(r) for r in made.collect()] == rows
    assert "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()
    assert common.local_rows(spark, [], "s string, l long").dtypes == [("s", "string"), ("l", "bigint")]


def test_sample_with_copies(spark):
    """A language that is mostly copies of one text still gives all its other texts."""
    rows = [(i, "same text", "en") for i in range(3000)] + [(5000 + i, f"text {words(i, 9)} {i}", "en") for i in range(40)] + [(9000, "seul", "fr"), (9001, "12", "fr"), (9002, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.labelled_sample(docs, "text", "lang", 60, 100_000)
    assert len(got) == len(set(got)) == 42 and ("seul", "fr") in got and ("same text", "en") in got


def test_gradient(spark):
    """Expected counts are the gradient of the log-partition, by differences."""
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))

    def partition(s, m):
        total = 0.0
        for own in s:
            paths = itertools.product(range(3), repeat=4)
            total += math.log(sum(math.exp(sum(own[t, y] for t, y in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:]))) for p in paths))
        return total

    unary, pair = lang_id._expected(scores, move)
    for at in itertools.product(range(2), range(4), range(3)):
        step = np.zeros_like(scores)
        step[at] = 1e-5
        assert unary[at] == pytest.approx((partition(scores + step, move) - partition(scores - step, move)) / 2e-5, abs=1e-6)
    for at in itertools.product(range(3), repeat=2):
        step = np.zeros_like(move)
        step[at] = 1e-5
        assert pair[at] == pytest.approx((partition(scores, move + step) - partition(scores, move - step)) / 2e-5, abs=1e-6)


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, move, lengths = rng.normal(size=(170, 3)) * 2, rng.normal(size=(3, 3)), [130, 0, 3, 37]
    got, at = lang_id.marginals(scores, np.array(lengths), move, block=16), 0
    for n in lengths:
        own = np.exp(scores[at : at + n])
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            a[t] = own[t] if t == 0 else (a[t - 1] @ np.exp(move)) * own[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(move) @ (own[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def records(n=6):
    return [warc.page_record(i, f"http://a/{i}", f"<p>{i}</p>".encode() * 40, warc.base32_sha1(f"<p>{i}</p>".encode() * 40), None, "2024-01-01T00:00:00Z") for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.gzip_member(r) if packed else r for r in records()]
    clean = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [x.headers["warc-record-id"] for x in clean] == [f"<urn:page:{i}>" for i in range(6)]
    broken = bytearray(b"".join(parts))
    start = len(parts[0]) + len(parts[1])
    for i in range(start + 30, start + 60):
        broken[i] ^= 0x55
    found = list(warc.salvage(io.BytesIO(bytes(broken))))
    assert [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    gap = next(x for x in found if isinstance(x, warc.Gap))
    assert (gap.start, gap.end) == (start, start + len(parts[2]))
    cut = list(warc.salvage(io.BytesIO(b"junk" + b"".join(parts)[:-9])))
    assert isinstance(cut[0], warc.Gap) and isinstance(cut[-1], warc.Gap) and sum(isinstance(x, warc.Record) for x in cut) == 5


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_random_damage(packed):
    """Whatever is flipped, cut or inserted: nothing raises, records and gaps tile the bytes, and untouched records are all found."""
    rng = np.random.default_rng(packed)
    for case in range(60):
        parts = [bytearray(warc.gzip_member(r) if packed else r) for r in records(8)]
        hurt = set(rng.choice(8, case % 8, replace=False).tolist())
        for p in hurt:
            at = int(rng.integers(len(parts[p])))
            kind = int(rng.integers(4))
            if kind == 0:
                parts[p][at] ^= 1 << int(rng.integers(8))
            elif kind == 1:
                del parts[p][at:]
            elif kind == 2:
                parts[p][at:at] = rng.bytes(int(rng.integers(1, 50)))
            else:  # headers: lengths that are no numbers, too large, or odd digits
                length = [b"\xc2\xb2", b"9" * 5000, b"-1", b"99999999", b""][case % 5]
                parts[p] = bytearray(re.sub(rb"(\r\nContent-Length: )[0-9]+(\r\n\r\nHTTP)", rb"\g<1>" + length + rb"\g<2>", bytes(records(8)[p])))
                if packed:
                    parts[p] = bytearray(warc.gzip_member(bytes(parts[p])))
        raw = b"".join(parts)
        found = list(warc.salvage(io.BytesIO(raw)))
        whole = {x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)}
        assert {f"<urn:page:{i}>" for i in range(8) if i not in hurt} <= whole
        at = 0
        for x in found:
            low, high = (x.start, x.end) if isinstance(x, warc.Gap) else (x.offset, x.offset + x.length)
            assert low in (at, was if at else 0) and high >= at  # several gaps of one member share its place
            was, at = low, high
        assert at == len(raw) or not raw


def test_salvage_is_linear():
    taken = []
    for n in (200, 400, 800):
        pages = [np.random.default_rng(i).bytes(3000) for i in range(n)]
        parts = [bytearray(warc.gzip_member(warc.page_record(i, "u", x, warc.base32_sha1(x), None, "d"))) for i, x in enumerate(pages)]
        for p in parts[::2]:
            p[40] ^= 0x55
        file = Counted(b"".join(parts))
        gaps = sum(isinstance(x, warc.Gap) for x in warc.salvage(file))
        taken.append(file.taken)
        assert abs(gaps - n // 2) <= 2  # now and then a flip leaves the contents as they were
    assert taken[1] < 2.2 * taken[0] and taken[2] < 2.2 * taken[1]


def test_large_members_and_long_urls(spark):
    """An archive packed as one member, and URLs of several MiB, are read whole."""
    packed = warc.gzip_member(b"".join(warc.page_record(i, "u", b"p" * 5_000_000, warc.base32_sha1(b"p" * 5_000_000), None, "d") for i in range(9)))
    assert [type(x) for x in warc.salvage(io.BytesIO(packed))] == [warc.Record] * 9
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 5_000_000, "same"), (2, "http://b/" + "y" * (1 << 20), "same"), (3, "c", "other")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: r.url for i, r in rows.items()} == {r.page_id: r.url for r in pages.collect()} and all(r.reason is None for r in rows.values())


def test_warc_rows(spark):
    """All columns of the query against a direct computation, with copies, revisits and foreign ids."""
    rng = np.random.default_rng(4)
    rows = [(int(i), f"u{i}", None if i % 9 == 0 else "" if i % 9 == 1 else f"page {rng.integers(12)} é" * int(rng.integers(1, 3))) for i in rng.permutation(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    want = {(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows}
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == 150 and {tuple(r) for r in got} == want
    assert warc._number("<urn:page:99999999999999999999>") is None and warc._number("<urn:page:\u00b2>") is None


def test_warc_round_trip(spark):
    rows = [(3, "http://x/ä", "same"), (1, None, "same"), (2, "u", None), (7, "u", ""), (None, "u", "same"), (9, "a\r\nb", "é" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].record_type == "response" and got[3].refers_to == 1 and got[None].refers_to == 1 and got[7].refers_to == 2
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), warc.base32_sha1(data))
    assert warc.round_trip(pages.limit(0)).count() == 0


def slow_align(text, item):
    h, best = np.zeros((len(item) + 1, len(text) + 1)), 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(30):
        text, item = (rng.integers(0, 4, n).astype(np.uint64) * np.uint64(8) for n in rng.integers(3, 20, 2))
        assert decontaminate.align([text], [item])[0][0] == slow_align(text, item)


def test_decontaminate(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    edited = item.replace("delta", "changed").replace("lambda ", "")
    items = spark.createDataFrame([(1, item), (2, words(9, 20)), (3, None), (4, "two words")], "item_id long, text string")
    rows = [(10, words(2, 50) + " " + item.upper() + ". " + words(3, 50)), (11, words(4, 40) + " " + edited), (12, words(5, 100)), (13, "alpha beta gamma only"), (14, "just two words here")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items, block_bytes=40).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 4)} and got[10, 1].score == 1.0 and (got[10, 1].start_word, got[10, 1].end_word) == (50, 66)
    assert 0.5 < got[11, 1].score < 1.0
    assert decontaminate.matches(odd, items).where("item_id = 1").count() == 0 and decontaminate.matches(none, items).count() == 0
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()) == [12, 13]
    assert decontaminate.remove_contaminated(odd, items.limit(0)).count() == len(ODD)


def test_decontaminate_templated_items(spark):
    """Items that differ in one word are found in exact and in edited copies, however they are dealt to blocks."""
    ends = ["france", "spain", "italy", "peru", "chad", "oman"]
    first = {i: f"what is the capital city of {w}" for i, w in enumerate(ends)}
    inner = {10 + i: f"please tell me in a few words why the people of {w} still like to eat their bread with some olive oil" for i, w in enumerate(ends)}
    items = spark.createDataFrame([*first.items(), *inner.items()], "item_id long, text string")
    rows, want = [], {}
    for i, t in [*first.items(), *inner.items()]:
        edited = t.replace("capital", "main") if i < 10 else t.replace("the people of", "a people from")
        for d, own in ((100 + 2 * i, t), (101 + 2 * i, edited)):
            rows.append((d, f"{words(d, 30)} {own} {words(d + 500, 30)}"))
            want[d] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (4 << 20, 150):
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(docs, items, block_bytes=block_bytes).collect()}
        assert all((d, i) in got for d, i in want.items())
        assert all(got[d, i] == 1.0 for d, i in want.items() if d % 2 == 0)
        assert all(got[d, i] >= max(s for (x, _), s in got.items() if x == d) for d, i in want.items())


def test_url_rules(spark):
    urls = [(1, "HTTPS://Bad.Example.com/x/9"), (2, "http://good.example.org/y"), (3, None), (4, "nothing"), (5, "http://www.example.com/en/1"), (6, "http://a.example.com/en/?q"), (7, "http://example.net")]
    rows = [(100 + i, f"http://bad.example.com/spam/{i}" if i % 2 else f"http://fine.example.org/y/{i}") for i in range(40)]
    pages = spark.createDataFrame(urls + rows, "page_id long, url string").withColumn("host", F.lit("own"))
    labelled = pages.where("page_id >= 100").withColumn("blocked", F.col("page_id") % 2 == 1)
    rules = [("allow", "com", "/en/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    got = {r.page_id: r for r in url_filter.judge(pages, rules, labelled).collect()}
    assert (got[1].host, got[1].path, got[1].verdict) == ("bad.example.com", "/x/9", "block")
    assert [got[i].verdict for i in (2, 3, 4)] == ["allow"] * 3 and got[3].host == got[4].host == got[3].path == ""
    assert got[5].rule == "www.example.com/en/" and got[5].verdict == "allow" and got[6].rule == "example.com/en/" and got[7].path == ""
    assert url_filter.judge(pages, rules, labelled.limit(0)).where("confidence is not null").count() == 0


def test_mined_rules(spark):
    """The rules against all token combinations of a small table, and a long shared path that costs nothing."""
    rng, rows = np.random.default_rng(5), []
    for i in range(300):
        site, tail = ["spam.org", "fine.org", "mixed.net"][i % 3], "/".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 3)), replace=False))
        rows.append((f"http://{site}/{tail}" + "?q=1" * int(rng.integers(2)), bool(site == "spam.org" or (site == "mixed.net" and "b" in tail))))
    rows += [("http://deep.org/" + "/".join(f"seg{x}x" for x in "abcdefghijklmnopqrstuvw"), True)] * 30 + [("http://x.y/z", None), (None, True)]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    tokens = {r.url: frozenset(r.t) for r in frame.select("url", url_filter.url_tokens(F.col("url")).alias("t")).distinct().collect()}
    known = [(tokens[u], b) for u, b in rows if b is not None and tokens[u]]
    pool = sorted({x for t, _ in known for x in t if "seg" not in x and x != "host=deep.org"})
    found = {}
    for n in (1, 2, 3):
        for own in map(frozenset, itertools.combinations(pool, n)):
            hit = [b for t, b in known if own <= t]
            if sum(hit) >= 20 and sum(hit) / len(hit) >= 0.6 and not any(s < own and c >= sum(hit) / len(hit) for s, c in found.items()):
                found[own] = sum(hit) / len(hit)
    rules = url_filter.mine_rules(frame).collect()
    got = {frozenset(c): r.confidence for r in rules for c in itertools.product(*r["items"]) if len(r["items"]) <= 3 and not any("seg" in x or "deep" in x for x in c)}
    assert got == pytest.approx(found) and found
    assert max(len(x) for r in rules for x in r["items"]) >= 24  # the shared path and its host are one item
    urls = spark.createDataFrame([("http://spam.org/new",), ("http://fine.org/a",), ("http://w.mixed.net/b",), ("http://o.org/segax",)], "url string")
    assert {r.url for r in url_filter.matched_urls(urls, url_filter.mine_rules(frame)).collect()} == {"http://spam.org/new", "http://w.mixed.net/b", "http://o.org/segax"}
    few = frame.where("blocked").limit(19)
    assert url_filter.mine_rules(few).count() == 0 and url_filter.mine_rules(frame.limit(0)).count() == 0


def test_chat(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (0, 2, "user", "left out"), (1, 0, "user", "other"), (1, 1, "assistant", "b<|im_end|>"), (2, 0, "user", None), (None, 0, "user", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"chosen": F.lit(1), "id": F.lit("own"), "_at": F.lit(2)})
    got = {r.conv_id: r for r in chat_format.format_pairs(chat_format.swapped_replies(frame)).collect()}
    assert set(got) == {0, 1} and got[0].prefix_turns == 1 and got[0].prompt == "<|im_start|>user\nq<|im_end|>\n"
    low, high = map(int, got[0].chosen_spans.split("-"))
    assert got[0].chosen[low:high] == "good<|im_end|>\n" and "<| im_end|>" in got[0].rejected
    assert chat_format.swapped_replies(frame.limit(0)).count() == 0
    alone = chat_format.format_pairs(chat_format.swapped_replies(frame.where("conv_id = 0"))).collect()
    assert [(r.prefix_turns, r.chosen, r.rejected, r.chosen_spans) for r in alone] == [(2, "", "", "")]


def test_chat_pairs_that_part_anywhere(spark):
    """Prefixes, completions and masks of pairs that part early or late, with unequal lengths and many replies, against a direct version."""
    rng, turns = np.random.default_rng(9), []
    for c in range(60):
        said = [("system" if i == 0 and c % 4 == 0 else ["user", "assistant"][int(rng.integers(2))], f"text {rng.integers(3)}") for i in range(int(rng.integers(1, 14)))]
        turns += [(c * 3, i, role, text) for i, (role, text) in enumerate(said)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    convs = {}
    for c, _, *turn in turns:
        convs.setdefault(c, []).append(tuple(turn))
    convs = {c: own[: max(i for i, t in enumerate(own) if t[0] == "assistant") + 1] for c, own in convs.items() if any(t[0] == "assistant" for t in own)}
    parted = set()
    for size in (1024, 7):
        groups, want = max(1, len(convs) // size), {}
        for c in convs:
            near = sorted(x for x in convs if x % groups == c % groups)
            other = next((x for x in near if x > c), near[0])
            a, b = ([i for i, t in enumerate(convs[x]) if t[0] == "assistant"] for x in (c, other))
            n = c % len(a)
            rejected = convs[c][: a[n]] + convs[other][b[min(n, len(b) - 1)] :]
            k = 0
            while k < min(len(rejected), len(convs[c])) and rejected[k] == convs[c][k]:
                k += 1
            parted.add(len(convs[c]) - k)
            render = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
            masked = lambda ts: [f"{t}<|im_end|>\n" for r, t in ts if r == "assistant"]
            want[c] = (other, k, render(convs[c][:k]), render(convs[c][k:]), render(rejected[k:]), masked(convs[c][k:]), masked(rejected[k:]))
        cut = lambda text, spans: [text[slice(*map(int, s.split("-")))] for s in spans.split(",") if s]
        rows = chat_format.format_pairs(chat_format.swapped_replies(frame, group=size), carry=("conv_id", "rejected_id")).collect()
        assert {r.conv_id: (r.rejected_id, r.prefix_turns, r.prompt, r.chosen, r.rejected, cut(r.chosen, r.chosen_spans), cut(r.rejected, r.rejected_spans)) for r in rows} == want
    assert len(parted) > 4


def test_search(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    data += [(1000 + i, data[3][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, [1.0] * 8)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, leaf_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in data if i is not None and i < 2000]
    hits = total = 0
    for q, v in good:
        if q % 20 == 0:
            want = sorted((-(v * u).sum(), i) for i, u in good if i != q)[:20]
            found = sorted(got[q])
            assert [x[0] for x in found] == list(range(1, 21)) and found == sorted(found, key=lambda x: (-x[2], x[1]))
            hits, total = hits + len({i for _, i in want} & {x[1] for x in found}), total + 20
    assert set(got) == {q for q, _ in good if q % 20 == 0} and hits / total >= 0.9
    assert ann.search(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(rows.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).count() == 2


def score_all(texts, items, threshold=0.5):
    """{(doc, item): score} of all pairs by Smith-Waterman, without seeds."""
    split = lambda t: decontaminate._hashes(decontaminate.words_of(t))
    pairs = [(d, i, split(t), split(x)) for d, t in texts for i, x in items]
    out = {}
    for at in range(0, len(pairs), 200):
        part = pairs[at : at + 200]
        best, _ = decontaminate.align([p[2] for p in part], [p[3] for p in part])
        out |= {(d, i): b / len(x) for (d, i, _, x), b in zip(part, best.tolist()) if b / len(x) >= threshold}
    return out


def test_decontaminate_against_all_pairs(spark):
    """200 texts, half with an edited item, against an alignment of every text with every item."""
    rng, vocab = np.random.default_rng(3), [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(9, 40))))) for i in range(40)]
    items += [(40 + i, f"a b c d e f u{i} v{i} w{i}") for i in range(5)]
    rows = []
    for d in range(200):
        own = items[d % 45][1].split()
        for p in rng.choice(len(own), len(own) // 6, replace=False):  # one word in six replaced, dropped or doubled
            own[p] = [f"x{d}", "", f"{own[p]} y{d}"][d % 3]
        rows.append((d, " ".join([*rng.choice(vocab, 60), *(own if d % 2 else []), *rng.choice(vocab, 30)])))
    rows += [(200, "a b c d e f u1"), (201, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = score_all([r for r in rows if r[1]], items)
    for block_bytes in (4 << 20, 2000, 10):
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(docs, bench, block_bytes=block_bytes).collect()}
        assert got == pytest.approx(want) and len(want) > 100 and got[200, 41] == pytest.approx(7 / 9)


def test_decontamination_memory(tmp_path):
    """What searching takes beside its batch doesn't follow the batch's size."""
    import pickle
    import tracemalloc

    seeds = decontaminate.seed_table([(1, " ".join(f"q{i}" for i in range(20)))], 3, np.zeros(0, dtype=np.uint64), 2, 0.5)
    (tmp_path / "seeds").write_bytes(pickle.dumps(vars(seeds)))
    rng = np.random.default_rng(5)
    batch = pa.record_batch({"t": [" ".join(f"v{x}" for x in rng.integers(1 << 20, size=250)) for _ in range(2_500)]})
    tracemalloc.start()
    assert sum(part.num_rows for part in decontaminate._clean([f"file://{tmp_path}/seeds"], 0.5, "t")(iter([batch]))) == 2_500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def test_remove_contaminated_rows(spark):
    """Rows go by their own text: null and repeated ids, and columns named like the operator's, are no matter."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, item), (None, "clean one"), (1, item), (1, "clean two"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"i": F.lit(1), "t": F.lit("x"), "doc": F.lit(2), "item_id": F.array(F.lit(3))})
    items = spark.createDataFrame([(None, item), (5, None), (5, "")], "item_id long, text string")
    left = decontaminate.remove_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(None, "clean one"), (1, "clean two"), (2, None), (3, "")]))
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(None, None), (1, None)}


def test_texts_longer_than_a_slice(spark):
    """Texts of several MB are read to their end by every operator that streams texts in slices."""
    import xxhash

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rng = np.random.default_rng(7)
    long = " ".join(f"v{x}" for x in rng.integers(1 << 30, size=400_000)) + " " + item
    assert len(long) > 4 << 20
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, long + " tail")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.start_word) for r in decontaminate.matches(docs, items).collect()} == {(1, 400_000), (3, 400_000)}
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()] == [2]
    own = long.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(len(own) - 2)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprints(docs).where("doc_id = 1").first().fp % (1 << 64) == want
    model = lang_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20, bits=10, epochs=2)
    spoken = spark.createDataFrame([(1, "the dog and " * 300_000)], "doc_id long, text string")
    row = lang_id.predict(spoken, model).first()
    assert row.lang_pred == "en" and row.n_letter_runs == 900_000
    kept = {r.doc_id: r for r in substring_dedup.remove_repeated_windows(docs).collect()}
    assert kept[1].n_removed == 0 and kept[3].n_removed == kept[1].n_words and kept[3].kept_text == "tail"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    texts = [(1, words(1, 80)), (2, words(1, 80) + " more"), (3, words(2, 60) + " " + item), (4, "123 456"), (5, None), (6, words(6, 70)), (7, words(7, 70))]
    # an id with a copy and with a text of its own, a repeated row, and rows without ids: a copy, an item, and a text of its own
    texts += [(8, words(1, 80)), (8, words(8, 70)), (7, words(7, 70)), (None, words(6, 70)), (None, words(2, 60) + " " + item), (None, words(10, 70))]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 1) for i, t in texts], DOCS)
    docs = docs.withColumns({"row": F.lit("own"), "_source": F.lit(1), "h": F.lit(2), "before": F.lit(3), "text_hash": F.lit(4), "t": F.lit("x"), "is_first": F.lit("y")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        was, now = now, common.staged(stage(spark, now, str(tmp_path)), name)
        assert name == "sharding" or now.columns == was.columns
        left[name] = sorted([(r.doc_id, r.text) for r in now.collect()], key=str)
    keep = lambda *gone: sorted([x for n, x in enumerate(texts) if n not in gone], key=str)
    assert left["language"] == keep(3, 4)
    assert left["near_duplicates"] == keep(1, 3, 4, 7, 9, 10, 11)
    assert left["decontamination"] == keep(1, 2, 3, 4, 7, 9, 10, 11)
    assert set(left["mixing"]) <= set(left["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = common.staged(stage(spark, none, str(tmp_path)), "none")
        assert none.count() == 0
