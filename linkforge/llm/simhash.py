"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Two fingerprints within ``radius``
differ in at least one segment by no more than that segment's share of the radius,
so every fingerprint enumerates the small Hamming ball of each of its segments,
fetches the table rows filed under those segment values and verifies the complete
distance. Segment values shared by more than ``bucket_cap`` fingerprints are not
compared pair by pair: their members meet at the points halfway between them (see
``_halfway``), which finds the same links with a bounded number of rows a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import connected_components, discard, staged, text_slices

BITS = 64
_SLICE = 4 << 20
_SKETCH = 1024
#: Eight byte lanes of a word, lane i holding bit i of the index.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` (run i begins at starts[i], ends at the next start), the bits set in over half of it."""
    lengths = np.diff(np.append(starts, len(hashes)))
    out = np.zeros(len(starts), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    begins, sizes = starts[full], lengths[full]
    # blocks of at most 255 hashes, so that byte lanes can't overflow
    n_blocks = -(-sizes // 255)
    first = np.cumsum(n_blocks) - n_blocks
    block = np.repeat(begins, n_blocks) + 255 * (np.arange(n_blocks.sum()) - np.repeat(first, n_blocks))
    as_bytes = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[as_bytes[:, k]], block).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for i in range(8):
            out[full] |= (2 * counts[:, i] > sizes).astype(np.uint64) << np.uint64(8 * k + i)
    return out


def shingle_hashes(data: bytes, width: int, distinct: bool = False) -> list[int]:
    """XXH64 (seed 42) of the space-joined ``width``-word shingles of ``data``, A-Z lower-cased; fewer words: of all of them."""
    words = data.lower().split()
    if not words:
        return []
    if width == 1:
        shingles = words
    elif len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        shingles = [flat[i : j - 1] for i, j in zip([0, *ends], ends[width - 1 :])]
    digest = xxhash.xxh64_intdigest
    return [digest(s, 42) for s in (set(shingles) if distinct else shingles)]


def _text_bits(texts: pa.Array, width: int, distinct: bool = False) -> np.ndarray:
    """The signed 64-bit fingerprint of each text, zero for null or wordless ones."""
    starts, hashes = [], []
    for text in texts:
        starts.append(len(hashes))
        hashes += shingle_hashes(text.as_py().encode(), width, distinct) if text.is_valid else []
    return majority_bits(np.array(hashes, dtype=np.uint64), np.array(starts, dtype=np.int64)).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distinct: bool = False) -> DataFrame:
    """``(id_col, fp)`` for every row; fp is the signed 64-bit fingerprint of the whole text, zero for null or wordless texts."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t", _SLICE):
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(_text_bits(part.column("t"), width, distinct))], ["i", "fp"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind.simpleString()}, fp long")
    return rows.withColumnRenamed("i", id_col)


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, mask of the segment's bits, ball of flips to try) per segment.

    With radius = segments*q + a, the first a+1 segments are searched to q flips and the
    others to q-1: if all of these fail, the distances add up to more than the radius.
    """
    q, a = divmod(radius, segments)
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    plan = []
    for t, (low, high) in enumerate(zip(cuts, cuts[1:])):
        flips = q if t <= a else q - 1
        if flips >= 0:
            ball = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(high - low), n)]
            plan.append((low, (1 << (high - low)) - 1, ball))
    return plan


def _halfway(members: DataFrame, radius: int) -> DataFrame:
    """Links of ``members(fp)`` through points within ceil(radius/2) of one and floor(radius/2) of the other.

    Members within floor(radius/2) of a point are within the radius of all others filed under
    it, so linking everyone to the smallest such member is valid, and joins all that are linked.
    """
    inner, outer = radius // 2, radius - radius // 2
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks = [signed(sum(1 << i for i in c)) for n in range(outer + 1) for c in combinations(range(BITS), n)]
    points = members.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= inner).alias("near"))
    hubs = points.where("near").groupBy("point").agg(F.min("fp").alias("hub"))
    return points.join(hubs, "point").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = 2, segments: int = 2, bucket_cap: int = 1024) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints of ``nodes(fp)`` (distinct) within ``radius`` of each other.

    Pairs in segment tables of up to ``bucket_cap`` rows are all returned; pairs in larger
    ones are returned directly or as a path over valid links.
    """
    plan = segment_plan(radius, segments)
    many = len(plan)
    seg = lambda low, mask: F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit(mask))
    table = nodes.select("fp", F.explode(F.array(*(seg(low, mask) * many + t for t, (low, mask, _) in enumerate(plan)))).alias("key"))
    probe = nodes.select("fp", F.explode(F.array(*(seg(low, mask).bitwiseXOR(F.lit(flips)) * many + t for t, (low, mask, ball) in enumerate(plan) for flips in ball))).alias("key"))
    hot = staged(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_cap).select("key"), "hot-segments")
    small = table.join(hot, "key", "left_anti").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    cold = probe.join(small, (probe.key == small.key) & (F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b").distinct()
    if hot.isEmpty():
        return cold
    return cold.unionByName(_halfway(probe.join(hot, "key", "left_semi").select("fp").distinct(), radius))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, segments: int = 2, distinct: bool = False, bucket_cap: int = 1024) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``; rows are linked if their fingerprints differ in up to ``radius`` bits.

    component_id is the smallest id reachable over links, the row's own included (null ids are
    never smallest; a group of null ids has a null component). Null, empty and wordless texts
    have fingerprint zero and are linked like any other; repeated rows are kept; other columns
    are ignored; an empty table gives an empty result. Equal fingerprints are one node, so
    groups of copies, however large, cost one row each.
    """
    fps = staged(fingerprints(docs, id_col, text_col, width, distinct), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprint-nodes")
    roots = connected_components(links(nodes.select("fp"), radius, segments, bucket_cap))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def fingerprint_pairs(nodes: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Candidate pairs ``(a, b)`` of ``nodes(node, fp)`` from the segment tables of ``links``.

    The smallest node of a fingerprint stands for it in the tables, and is paired with the others of that fingerprint.
    """
    hubs = staged(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprint-hubs")
    equal = nodes.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    hub_of = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}"))
    apart = links(hubs.select("fp"), radius, segments).join(hub_of("a"), "a").join(hub_of("b"), "b")
    out = staged(equal.unionByName(apart.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))).distinct(), "fingerprint-pairs")
    discard(hubs)
    return out


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, shingles)``: the sorted distinct XXH64 values of each text's ``width``-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t", _SLICE):
            sets = [np.unique(np.array(shingle_hashes(t.as_py().encode(), width), dtype=np.uint64)).view(np.int64) if t.is_valid else [] for t in part.column("t")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "node long, shingles array<long>")


def odd_sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, size, sketch)``: how many distinct ``width``-word shingles each text has, and the parity of their number in each of 1,024 hash buckets.

    What two texts share cancels out, so the bits in which their sketches differ are never more than
    the shingles in which the texts differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t", _SLICE):
            sets = [shingle_hashes(t.as_py().encode(), width, distinct=True) if t.is_valid else [] for t in part.column("t")]
            odd = [np.bincount(np.array(x, dtype=np.uint64).astype(np.int64) & (_SKETCH - 1), minlength=_SKETCH) & 1 for x in sets]
            sketches = [np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64) for x in odd]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], ["node", "size", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "node long, size int, sketch array<long>")


def _may_be_similar(least: float) -> F.Column:
    """False only where ``size, sketch`` and ``other_size, other_sketch`` rule out a Jaccard similarity of ``least``: at that, the texts differ in at most (1-least)/(1+least) of the sum of their sizes."""
    most = (F.col("size") + F.col("other_size")) * ((1 - least) / (1 + least)) + 1e-6
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other_sketch")[i])) for i in range(_SKETCH // 64)), F.lit(0))
    return (F.abs(F.col("size") - F.col("other_size")) <= most) & (apart <= most)


def _wide_may_be_similar(least: float) -> F.Column:
    """``_may_be_similar`` by the sketches ``wide`` and ``other_wide``, the longer one folded to the length of the shorter."""
    fold = lambda a, b: f"if(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (x, y) -> x ^ y), {a})"
    apart = F.expr(f"aggregate(zip_with({fold('wide', 'other_wide')}, {fold('other_wide', 'wide')}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    # sizes of similar texts are within 4 of 5, so their lengths are equal or one is twice the other
    known = F.greatest(F.size("wide"), F.size("other_wide")) <= 2 * F.least(F.size("wide"), F.size("other_wide"))
    return ~known | (apart <= (F.col("size") + F.col("other_size")) * ((1 - least) / (1 + least)) + 1e-6)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets have a Jaccard similarity of at least ``least``."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") >= least * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def common_shingles(docs: DataFrame, id_col: str, text_col: str, width: int, sample: int = 16_384, least: int = 8, most: int = 100_000) -> list[tuple[int, int]]:
    """``(hash, texts)`` of the shingles in at least ``least`` of about ``sample`` texts. They only set the order in which prefixes are cut, so no link depends on them."""
    part = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(part)) == 0)
    counts = shingle_sets(some.select(F.col(id_col).alias("node"), text_col), "node", text_col, width).select(F.explode("shingles").alias("h")).groupBy("h").count()
    return [(r.h, r["count"]) for r in counts.where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).collect()]


def prefix_rows(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, common: list[tuple[int, int]]) -> DataFrame:
    """``(id_col, text_hash, copy, fp, size, sketch, wide, keys)``: keys are the first of a text's distinct shingles in one order for all texts, those of ``common`` last.

    Two texts with a Jaccard similarity of at least ``similarity`` share ``similarity`` of either's n shingles,
    so they share one of the first n - ceil(similarity * n) + 1. copy is the XXH3-128 digest of the
    lower-cased words, text_hash XXH64 of the text as it is, fp the text's fingerprint as in ``fingerprints``; for size and sketch see ``odd_sketches``. wide is a sketch of at least half as many bits as
    the text has shingles, as one of 1,024 bits rejects little for long texts.
    """
    kind = docs.schema[id_col].dataType
    hashes = np.array(sorted(h for h, _ in common), dtype=np.int64)
    texts = np.array([n for _, n in sorted(common)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t", _SLICE // 2):
            copies, sizes, sketches, wides, keys = [], [], [], [], []
            for text in part.column("t"):
                data = text.as_py().encode() if text.is_valid else b""
                own = np.unique(np.array(shingle_hashes(data, width), dtype=np.uint64).view(np.int64))
                copies.append(xxhash.xxh3_128_digest(b" ".join(data.lower().split())))
                sizes.append(len(own))
                bits = max(_SKETCH, 1 << max(0, len(own) // 2 - 1).bit_length())
                odd = np.bincount(own & (bits - 1), minlength=bits) & 1
                wides.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                sketches.append(np.bitwise_xor.reduce(wides[-1].reshape(-1, _SKETCH // 64), axis=0))
                if len(hashes) and len(own):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    own = own[np.argsort(np.where(hashes[at] == own, texts[at], 0), kind="stable")]
                # the small number keeps rounding from cutting a prefix short
                keys.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-6) + 1] if len(own) else own)
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), pa.array(copies, pa.binary()), pa.array(_text_bits(part.column("t"), 3)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(wides, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["i", "text_hash", "copy", "fp", "size", "sketch", "wide", "keys"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))
    return rows.mapInArrow(run, f"i {kind.simpleString()}, text_hash long, copy binary, fp long, size int, sketch array<long>, wide array<long>, keys array<long>").withColumnRenamed("i", id_col)


def verified_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bucket_cap: int = 32) -> DataFrame:
    """``(id_col, text_hash, component_id, is_first)`` for every row: groups of texts whose Jaccard similarity on ``width``-word shingles is at least ``similarity``.

    component_id is the smallest id of the group, null if it has none. The group's first rows, those with that id
    and, if it has several texts, with the smallest text_hash, are flagged; so are rows that repeat them.
    Candidates are first the texts whose fingerprints meet in the segment tables of ``links``; the exact check decides
    on each. Cut and extended texts can differ in more bits, so texts of different components so far are candidates too if they share a
    shingle of their prefixes (see ``prefix_rows``), which every similar pair
    does, whatever was replaced, cut or added; sizes, places in the prefix and odd sketches rule out only
    what the exact check would. Texts with the same words are one node, whatever their ids. In buckets of up to
    ``bucket_cap`` nodes all candidates are checked. In larger ones every node is checked against the
    bucket's leader, and then against the members that are still in another component. So a dense
    group costs a few checks a member, yet no pair that could join two components goes unchecked. Null ids
    are ids like others, after all of them; rows of one id with different texts are rows of their own; null and
    wordless texts group as copies; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    rows = staged(prefix_rows(docs, id_col, text_col, width, similarity, common_shingles(docs, id_col, text_col, width)), "prefixes")
    unique = rows.groupBy(id_col, "text_hash").count().where("count > 1").isEmpty()
    least = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), "text_hash")).alias("least")
    # the numbers are fixed once the table is written
    nodes = staged(rows.groupBy("copy").agg(least, *(F.first(c).alias(c) for c in ("fp", "size", "sketch", "wide", "keys"))).withColumn("node", F.monotonically_increasing_id()), "copy-nodes")
    table = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    table = staged(table.withColumn("n", F.expr("count(1) over (partition by key)")).where("n > 1"), "postings")
    other = lambda df: df.select(*(c if c == "key" else F.col(c).alias("other" if c == "node" else f"other_{c}") for c in df.columns))
    ordered = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    # so many shingles two texts share at least; from their first shared one on, no more than either has left
    share = (F.col("size") + F.col("other_size")) * (similarity / (1 + similarity)) - 1e-6
    sizes = F.least("size", "other_size") >= share
    fits = sizes & (F.least(F.col("size") - F.col("pos"), F.col("other_size") - F.col("other_pos")) >= share)

    def texts_of(wanted: DataFrame) -> DataFrame:
        some = wanted.distinct().join(nodes.select("node", F.col("least.id").alias("_id"), F.col("least.text_hash").alias("_hash")), "node")
        same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
        texts = docs.join(some, same).select("node", text_col)
        return texts if unique else texts.dropDuplicates(["node"])

    def rooted_by(roots: DataFrame) -> DataFrame:
        return staged(nodes.select("node", "size", "sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")

    def links_of(pairs: DataFrame, part: DataFrame) -> DataFrame:
        """The similar ones of ``pairs`` whose roots in ``part(node, size, sketch, root)`` differ."""

        def beside(of: DataFrame, own: DataFrame) -> DataFrame:
            return of.join(own.withColumnRenamed("node", "a"), "a").join(other(own).withColumnRenamed("other", "b"), "b")

        left = staged(beside(pairs, part).where((F.col("root") != F.col("other_root")) & _may_be_similar(similarity)).select("a", "b"), "sketched-pairs")
        near = staged(beside(left, nodes.select("node", "size", "wide")).where(_wide_may_be_similar(similarity)).select("a", "b"), "pairs")
        sets = staged(shingle_sets(texts_of(near.select(F.explode(F.array("a", "b")).alias("node"))), "node", text_col, width), "shingle-sets")
        found = staged(_similar(near, sets, similarity), "links")
        discard(left, near, sets)
        return found

    small, large = table.where(F.col("n") <= bucket_cap), table.where(F.col("n") > bucket_cap).drop("n")
    pairs = small.drop("n").join(other(small.drop("n")), "key").where((F.col("node") < F.col("other")) & fits).select(*ordered)
    leader = F.min(F.struct(F.xxhash64("node", F.col("key").bitwiseAND(F.lit(7))).alias("h"), F.col("node").alias("other"), F.col("size").alias("other_size"))).alias("x")
    leaders = staged(large.groupBy("key").agg(leader).select("key", "x.other", "x.other_size"), "leaders")
    led = large.join(leaders, "key").where((F.col("node") != F.col("other")) & sizes).select(*ordered)
    met = fingerprint_pairs(nodes.select("node", "fp"))
    linked = links_of(met, nodes.select("node", "size", "sketch", F.col("node").alias("root")))
    roots = connected_components(linked)
    part = rooted_by(roots)
    more = links_of(pairs.unionByName(led).distinct(), part)
    discard(met, roots, part)
    linked, found = linked.unionByName(more), (linked, more)
    roots = connected_components(linked)
    if not leaders.isEmpty():
        # a large bucket's main component is its leader's; members of it need no check against one another
        part = rooted_by(roots)
        main = leaders.select("key", F.col("other").alias("node")).join(part, "node").select("key", F.col("root").alias("main"))
        members = staged(large.join(part.drop("size"), "node").join(main, "key"), "members")
        apart = (F.col("root") != F.col("other_root")) & fits & _may_be_similar(similarity)
        rest = members.where("root <> main").drop("main").join(other(members.drop("main")), "key").where(apart).select(*ordered)
        rest = staged(rest.distinct(), "cross-pairs")
        discard(members)
        if not rest.isEmpty():
            more = links_of(rest, part)
            discard(roots)
            roots = connected_components(linked.unionByName(more))
            discard(more)
        discard(part, rest)
    discard(table, leaders, *found)
    rooted = nodes.select("copy", "node", "least").join(roots, "node", "left").select("copy", "least", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    grouped = rooted.join(first, "root").select("copy", F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("_first"))
    is_first = F.col(id_col).cast("long").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("_first"))
    out = staged(rows.select(id_col, "text_hash", "copy").join(grouped, "copy").select(id_col, "text_hash", "component_id", is_first.alias("is_first")), "groups")
    discard(rows, nodes, roots)
    return out
