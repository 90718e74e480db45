"""Exact removal of repeated word windows by super-k-mer partitioning.

Each window of ``k`` words has a minimiser: the least hash of its ``m``-word substrings.
Consecutive windows with the same minimiser form a super-k-mer, which travels once, as one
packed string, to the minimiser's bucket. All copies of a window meet there, and sorting
the windows groups them exactly, on their bytes. Word strings that many documents have come last in the order of
minimisers, so a common phrase doesn't draw all windows around it to one bucket. Before the shuffle equal super-k-mers of
a task's input are merged to the one of the smallest document; the others' windows are
marked at once, so a passage repeated in many documents costs a bucket about one string a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import text_slices

_SLICE = 2 << 20
_LAST = (1 << 63) - 1
_PRIME = 0x9E3779B97F4A7C15
_U = np.uint64
#: Windows known to be repeated: document, its text's hash, first window, number of windows.
_MARK = np.dtype([("doc", "<i8"), ("fp", "<i8"), ("pos", "<i4"), ("n", "<i4")])
#: Bytes of strings whose windows are hashed at once, and sorted at once.
_CHUNK, _PASS = 1 << 20, 24 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n each."""
    global _pow, _inv
    if len(_pow) < n:
        size, made = 1 << (n - 1).bit_length(), []
        for number in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            factors = np.full(size, number, dtype=np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors, dtype=np.uint64))
        _pow, _inv = made
    return _pow[:n], _inv[:n]


def word_hashes(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each space-separated word of ``flat``; equal words have equal hashes."""
    return _word_hashes(flat)[:3]


def _word_hashes(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the running sums and factors that make a hash of any other part of ``flat``."""
    codes = np.frombuffer(flat, dtype=np.uint8)
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(flat)]])
    up, down = _powers(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + _U(1)) * up[:-1], dtype=np.uint64)])
    return starts, ends, _mix((sums[ends] - sums[starts]) * down[starts]), sums, down


def _grams(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of ``m`` word hashes."""
    grams = np.zeros(max(0, len(words) - m + 1), dtype=np.uint64)
    for i in range(m):
        grams = _mix(grams * _U(_PRIME) + words[i : i + len(grams)])
    return grams


def minimisers(words: np.ndarray, k: int, m: int, common: np.ndarray) -> np.ndarray:
    """For each window of ``k`` word hashes, the least of its ``m``-word substrings' hashes, the (sorted) common ones after all others."""
    grams = _grams(words, m)
    late = np.zeros(len(grams), dtype=np.uint64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        late = (common[at] == grams).astype(np.uint64)
    grams = (grams >> _U(1)) | (late << _U(63))
    width, least, span = k - m + 1, grams, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least


def common_strings(docs: DataFrame, text_col: str, m: int, sample: int = 16_384, least: int = 8, most: int = 100_000) -> np.ndarray:
    """Sorted hashes of the ``m``-word strings in at least ``least`` of about ``sample`` texts, ``most`` at most.

    They only set which bucket a window goes to: no result depends on them. The driver collects them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", _SLICE):
            grams = [np.unique(_grams(word_hashes(b" ".join(w))[2], m)) for w in (t.as_py().encode().split() for t in part.column("text")) if len(w) >= m]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)).view(pa.int64())], ["h"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    part = max(1, texts.count() // sample)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0) if part > 1 else texts
    counts = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.array(sorted(r.h % (1 << 64) for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()), dtype=np.uint64)


@dataclass
class SuperKmers:
    """Those of some documents: their parts of ``flat`` (words joined by blanks), documents, first windows, window counts."""

    flat: bytes
    h: np.ndarray
    owner: np.ndarray  # place of the document in the list
    pos: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray  # a hash of the bytes from low to high

    def packed(self, x: int) -> bytes:
        return self.flat[self.low[x] : self.high[x]]


def super_kmers(docs: list[list[bytes]], k: int, m: int, common: np.ndarray) -> SuperKmers | None:
    """Each document's runs of windows with one minimiser; the words of all documents are hashed together."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    flat = b" ".join(b" ".join(d) for d in docs if d)
    if not flat or sizes.max() < k:
        return None
    starts, ends, words, sums, down = _word_hashes(flat)
    if len(words) < k:
        return None
    least = minimisers(words, k, m, common)
    owner = np.repeat(np.arange(len(docs)), sizes)
    # windows within one document, and the first ones of their runs
    inside = owner[: len(least)] == owner[k - 1 :]
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (owner[1 : len(least)] != owner[: len(least) - 1])
    at = np.flatnonzero(first)
    if not len(at):
        return None
    # a run ends before the next one, or with its document's last window
    last = np.cumsum(sizes) - k
    stop = np.minimum(np.append(at[1:], len(least)) - 1, last[owner[at]])
    low, high = starts[at], ends[stop + k - 1]
    begin = np.cumsum(sizes) - sizes
    return SuperKmers(flat, least[at], owner[at], at - begin[owner[at]], stop - at + 1, low, high, _mix((sums[high] - sums[low]) * down[low]))


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from low[i] on, size[i] of them, for each i in turn."""
    shift = np.cumsum(size) - size
    return np.repeat(low - shift, size) + np.arange(size.sum())


def _merge(found: SuperKmers, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[bytes, tuple[int, int]]]:
    """(kept, marked, repeated): of equal super-k-mers those in the smallest document are kept; the others' windows are repeated.

    ``repeated`` has the hash and that document of each string with several.
    """
    order = np.argsort(found.key, kind="stable")
    same = found.key[order][1:] == found.key[order][:-1]
    drop = np.zeros(len(order), dtype=bool)
    repeated: dict[bytes, tuple[int, int]] = {}
    if same.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            own = order[a : b + 1]
            least: dict[bytes, int] = {}
            strings = [found.packed(x) for x in own.tolist()]
            for s, d in zip(strings, doc[own].tolist()):
                if d < least.get(s, d + 1):
                    least[s] = d
            drop[own] = [d > least[s] for s, d in zip(strings, doc[own].tolist())]
            repeated |= {s: (int(found.key[own[0]]), d) for s, d in least.items()}
    return np.flatnonzero(~drop), np.flatnonzero(drop), repeated


class _Sent:
    """Strings that a task has found repeated, with the smallest document that it has sent each for; ``most`` at once."""

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.docs, self.keys = most, {}, np.zeros(0, dtype=np.uint64)

    def known(self, found: SuperKmers, doc: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Which of ``kept`` were already sent for a smaller document, so that their windows are repeated."""
        out = np.zeros(len(kept), dtype=bool)
        for x in np.flatnonzero(np.isin(found.key[kept], self.keys)).tolist() if len(self.keys) else []:
            out[x] = self.docs.get(found.packed(kept[x]), (0, _LAST))[1] < doc[kept[x]]
        return out

    def add(self, repeated: dict[bytes, tuple[int, int]]) -> None:
        if len(self.docs) + len(repeated) > self.most:
            self.docs.clear()
        for s, (key, d) in repeated.items():
            self.docs[s] = key, min(d, self.docs.get(s, (0, _LAST))[1])
        if repeated:
            self.keys = np.array([key for key, _ in self.docs.values()], dtype=np.uint64)


def _pack(found: SuperKmers, rows: np.ndarray, doc: np.ndarray, fp: np.ndarray, marks: np.ndarray, flat: np.ndarray) -> bytes:
    """Columns one after the other, ids as differences, then the strings with their separators: for the compressor."""
    text = b""
    if len(rows):
        size = found.high[rows] - found.low[rows] + 1
        codes = flat[_ranges(found.low[rows], size)]
        codes[np.cumsum(size) - 1] = 10
        text = codes.tobytes()
    head = [np.array([len(rows), len(marks)], dtype="<i8"), np.diff(doc[rows], prepend=0).astype("<i8"), fp[rows].astype("<i8"), (found.h[rows] >> _U(32)).astype("<u4"), found.pos[rows].astype("<i4")]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([*(x.tobytes() for x in head), marks.tobytes(), text]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(doc, fp, h, pos, marks, strings)"""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    a, b = np.frombuffer(raw, dtype="<i8", count=2).tolist()
    doc = np.cumsum(np.frombuffer(raw, dtype="<i8", count=a, offset=16))
    fp = np.frombuffer(raw, dtype="<i8", count=a, offset=16 + 8 * a)
    h = np.frombuffer(raw, dtype="<u4", count=a, offset=16 + 16 * a)
    pos = np.frombuffer(raw, dtype="<i4", count=a, offset=16 + 20 * a)
    marks = np.frombuffer(raw, dtype=_MARK, count=b, offset=16 + 24 * a)
    return doc, fp, h, pos, marks, raw[16 + 24 * a + marks.nbytes :]


def _partition_of(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Where Spark's hash partitioning sends an integer: Murmur3 (x86, 32 bits, seed 42) modulo the number of partitions."""
    u = np.uint32
    turn = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    k = turn(keys.astype(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = turn(u(42) ^ k, 13) * u(5) + u(0xE6546B64)
    h ^= u(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(factor)
    return (h ^ (h >> u(16))).view(np.int32) % partitions


def bucket_keys(buckets: int, partitions: int) -> np.ndarray:
    """A number for each bucket, such that hash partitioning deals the buckets evenly to the partitions."""
    each = -(-buckets // partitions)
    keys = np.arange(4 * each * partitions + 64 * partitions, dtype=np.int64)
    order = np.argsort(_partition_of(keys, partitions), kind="stable")
    first = np.searchsorted(_partition_of(keys, partitions)[order], np.arange(partitions + 1))
    if np.diff(first).min() < each:
        return np.arange(buckets)
    return np.concatenate([keys[order[first[:-1] + j]] for j in range(each)])[:buckets]


def _scatter(k: int, m: int, buckets: int, common: np.ndarray, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for part in text_slices(batches, "text", _SLICE):
            found = super_kmers([t.as_py().encode().split() if t.is_valid else [] for t in part.column("text")], k, m, common)
            if found is None:
                continue
            doc = part.column("doc").to_numpy()[found.owner]
            fp = part.column("fp").to_numpy()[found.owner]
            kept, marked, repeated = _merge(found, doc)
            again = sent.known(found, doc, kept)
            sent.add(repeated)
            kept, marked = kept[~again], np.concatenate([marked, kept[again]])
            marks = np.zeros(len(marked), dtype=_MARK)
            marks["doc"], marks["fp"], marks["pos"], marks["n"] = doc[marked], fp[marked], found.pos[marked], found.n[marked]
            to = (found.h[kept] % _U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            kept, cuts = kept[order], np.searchsorted(to[order], np.arange(buckets + 1))
            to = marks["doc"] % buckets
            order = np.argsort(to, kind="stable")
            marks, mark_cuts = marks[order], np.searchsorted(to[order], np.arange(buckets + 1))
            flat = np.frombuffer(found.flat + b"\n", dtype=np.uint8)
            full = [b for b in range(buckets) if cuts[b + 1] > cuts[b] or mark_cuts[b + 1] > mark_cuts[b]]
            blobs = [_pack(found, kept[cuts[b] : cuts[b + 1]], doc, fp, marks[mark_cuts[b] : mark_cuts[b + 1]], flat) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(keys[full], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _windows(codes: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, row, place in the row, first byte, end) of all windows of the strings ``rows``, in chunks of about _CHUNK bytes."""
    sizes = ends[rows] - starts[rows] + 1  # each with its separator
    part = np.cumsum(sizes) // _CHUNK
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
        if not len(own):
            continue
        low, size = starts[rows[own]], sizes[own]
        text = codes[_ranges(low, size)]
        gaps = np.flatnonzero((text == 32) | (text == 10))
        begin = np.concatenate([[0], gaps[:-1] + 1])
        up, down = _powers(len(text) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((text.astype(np.uint64) + _U(1)) * up[:-1], dtype=np.uint64)])
        first_byte = np.cumsum(size) - size
        row = np.searchsorted(first_byte, begin, side="right") - 1
        if len(row) < k:
            continue
        at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        a, b = begin[at], gaps[at + k - 1]
        first_word = np.searchsorted(row, row[at])
        shift = low[row[at]] - first_byte[row[at]]
        yield _mix((sums[b] - sums[a]) * down[a]), rows[own][row[at]], at - first_word, a + shift, b + shift


def repeated_windows(raw: bytes, doc: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, window of the row) of the windows whose words also start in a smaller document.

    Windows are sorted by a hash of their bytes and, where they meet, compared on the bytes. If there are
    many they are taken in several passes, each with its own hash values, so memory is bounded.
    """
    codes = np.frombuffer(raw, dtype=np.uint8)
    passes = int((ends[rows] - starts[rows]).sum() // _PASS) + 1
    for turn in range(passes):
        taken = []
        for found in _windows(codes, rows, starts, ends, k):
            own = np.flatnonzero(found[0] % _U(passes) == turn) if passes > 1 else slice(None)
            taken.append([x[own] for x in found])
        if not taken:
            return
        h, row, place, low, high = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(h, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1, [len(h)]])
        owner = doc[row[order]]
        if not len(owner):
            continue
        least = np.minimum.reduceat(owner, cuts[:-1])
        mixed = np.flatnonzero(least < np.maximum.reduceat(owner, cuts[:-1]))
        hits = []
        for g in mixed.tolist():
            same = order[cuts[g] : cuts[g + 1]]
            lows, highs = low[same].tolist(), high[same].tolist()
            first = raw[lows[0] : highs[0]]
            if all(raw[a:b] == first for a, b in zip(lows, highs)):
                hits.append(same[owner[cuts[g] : cuts[g + 1]] > least[g]])
            else:  # different words with one hash
                strings = [raw[a:b] for a, b in zip(lows, highs)]
                for _, equal in groupby(sorted(range(len(same)), key=strings.__getitem__), key=strings.__getitem__):
                    equal = same[list(equal)]
                    hits.append(equal[doc[row[equal]] > doc[row[equal]].min()])
        if hits:
            hits = np.concatenate(hits)
            yield row[hits], place[hits]


def _gather(k: int):
    def run(key, table):
        parts = [_unpack(b.as_py()) for b in table.column("blob")]
        doc, fp, h, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
        marks = [p[4] for p in parts]
        raw = b"".join(p[5] for p in parts)
        del parts
        ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        order = np.argsort(h, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1, [len(h)]])
        if len(h):  # minimisers that several documents have
            owner = doc[order]
            several = np.minimum.reduceat(owner, cuts[:-1]) < np.maximum.reduceat(owner, cuts[:-1])
            rows = order[np.repeat(several, np.diff(cuts))]
            for row, place in repeated_windows(raw, doc, rows, starts, ends, k):
                found = np.zeros(len(row), dtype=_MARK)
                found["doc"], found["fp"], found["pos"], found["n"] = doc[row], fp[row], pos[row] + place, 1
                marks.append(found)
        mark = np.concatenate(marks)
        if not len(mark):
            return pa.table({"doc": pa.array([], pa.int64()), "fp": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        mark = mark[np.lexsort((mark["pos"], mark["fp"], mark["doc"]))]
        cuts = np.concatenate([[0], np.flatnonzero((mark["doc"][1:] != mark["doc"][:-1]) | (mark["fp"][1:] != mark["fp"][:-1])) + 1, [len(mark)]])
        spans = np.ascontiguousarray(np.stack([mark["pos"], mark["n"]], axis=1))
        return pa.table({"doc": mark["doc"][cuts[:-1]], "fp": mark["fp"][cuts[:-1]], "marks": pa.array([spans[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return run


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, to halve what the join with the marks shuffles."""
    press = zstandard.ZstdCompressor(level=3)
    for part in text_slices(batches, "text", _SLICE):
        packed = [press.compress(t.as_py().encode()) if t.is_valid else None for t in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc"), part.column("fp"), pa.array(packed, pa.binary())], ["id", "doc", "fp", "packed"])


def _strip(k: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in text_slices(batches, "packed", _SLICE // 4):
            total, gone, digests, kept_texts = [], [], [], []
            for packed, marks in zip(part.column("packed"), part.column("marks")):
                words = unpack.decompress(packed.as_py()).split() if packed.is_valid else []
                removed = 0
                if marks.is_valid:
                    cover = np.zeros(len(words) + 1, dtype=np.int32)
                    for blob in marks.as_py():
                        spans = np.frombuffer(blob, dtype="<i4").reshape(-1, 2)
                        np.add.at(cover, spans[:, 0], 1)
                        np.add.at(cover, spans[:, 0] + spans[:, 1] + k - 1, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    removed = int(len(words) - keep.sum())
                    kept = b" ".join([w for w, x in zip(words, keep.tolist()) if x])
                else:
                    kept = b" ".join(words)
                total.append(len(words))
                gone.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3, bucket_bytes: int = 32 << 20, texts: bool = True) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256, kept_text)`` of every row; without ``texts`` kept_text is null.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D. Each word covered by a window of ``k``
    words whose sequence also starts in a row with a smaller id is removed; windows are judged
    on the input. A null text has no words, so its kept text is empty. A null id counts as larger
    than every other. Rows with equal ids don't remove each other's words; repeated rows are
    kept; other columns are ignored; an empty table gives an empty result.
    The number of buckets grows with the bytes of text, so that each holds about ``bucket_bytes``; they are dealt evenly to the shuffle's partitions.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    # where ids are unique they tell rows apart; else the text's hash does too
    unique = docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    fp = F.lit(0).cast("long") if unique else F.xxhash64(text)
    base = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), fp.alias("fp"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-4 * size // bucket_bytes))
    sent = base.select("doc", "fp", "text").mapInArrow(_scatter(k, m, buckets, common_strings(docs, text_col, m), bucket_keys(buckets, partitions)), "bucket int, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(_gather(k), "doc long, fp long, marks binary")
    marks = marks.groupBy("doc", "fp").agg(F.collect_list("marks").alias("marks"))  # at most as long as the document
    packed = base.mapInArrow(_pressed, f"id {kind}, doc long, fp long, packed binary")
    joined = packed.join(marks.hint("shuffle_hash"), ["doc", "fp"], "left").select("id", "packed", "marks")
    return joined.mapInArrow(_strip(k, texts), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
