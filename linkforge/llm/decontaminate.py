"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Seeds are the word n-grams of the test items, without those that too many items share where
an item has enough others. A
passage of a training text that holds several seeds of an item is aligned with the item by
Smith-Waterman on words, so that copies with replaced, inserted or missing words still score.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import discard, shared_dir, staged, text_slices
from linkforge.llm.substring_dedup import _mix, word_hashes

#: Bytes of texts that are searched at once: a worker's memory is many times that.
_SLICE = 512 << 10
_U = np.uint64
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return _WORD.findall(text.lower().encode())


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return word_hashes(b" ".join(words))[2] if words else np.zeros(0, dtype=np.uint64)


@dataclass
class Seeds:
    """Seed table of some items, in flat arrays: sorted hashes, and from ``first[i]`` on the items and places that have hash i.

    Items shorter than a seed are in ``short``, by their length: sorted hashes of the whole items, and the items.
    """

    n: int
    ids: list[int | None]
    words: np.ndarray  # of all items, one after the other
    starts: np.ndarray
    need: np.ndarray  # seeds that a passage must hold
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    def text(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k + 1]]

    def size(self, k: int) -> int:
        return int(self.starts[k + 1] - self.starts[k])


def seed_table(items: list[tuple[int | None, str]], n: int, shared: np.ndarray, least_seeds: int, threshold: float) -> Seeds:
    """The seeds of ``items(id, text)``; ``shared`` are the sorted hashes that too many of all items hold.

    An item does without its shared seeds only if as many replaced words as a score of ``threshold``
    allows, each of which breaks n seeds, leave ``least_seeds`` of the others; if not, it keeps all. So an item's
    seeds depend on itself and on ``shared`` only, not on the items that it is filed with.
    """
    texts = [_hashes(words_of(t)) for _, t in items]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    grams = [_grams(t, n) for t in texts]
    keys = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, dtype=np.int32)
    rare = ~np.isin(keys, shared)
    allowed = n * (sizes * (1 - threshold) / 2).astype(np.int64)
    enough = np.bincount(owner[rare], minlength=len(items)) - allowed >= least_seeds
    kept = np.flatnonzero(rare | ~enough[owner])
    kept = kept[np.argsort(keys[kept], kind="stable")]
    found, first = np.unique(keys[kept], return_index=True)
    short = {}
    for w in range(1, n):
        own = np.flatnonzero(sizes == w)
        whole = np.array([_grams(texts[k], w)[0] for k in own], dtype=np.uint64)
        order = np.argsort(whole, kind="stable")
        if len(own):
            short[w] = whole[order], own[order]
    need = np.minimum(least_seeds, np.bincount(owner[kept], minlength=len(items)))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return Seeds(n, [i for i, _ in items], np.concatenate(texts) if texts else keys, starts, need, found, np.append(first, len(kept)), owner[kept], place[kept], short)


def align(passages: list[np.ndarray], items: list[np.ndarray], match: float = 1.0, mismatch: float = -1.0, gap: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each passage with its item, all at once: (best score, end in the passage)."""
    wide, tall = max(map(len, passages)), max(map(len, items))
    text, item = np.zeros((len(passages), wide), dtype=np.uint64), np.ones((len(items), tall), dtype=np.uint64)
    for r, (a, b) in enumerate(zip(passages, items)):
        text[r, : len(a)], item[r, : len(b)] = a | _U(2), b | _U(2)
    slope = gap * np.arange(wide)
    row, best, end = np.zeros((len(passages), wide + 1)), np.zeros(len(passages)), np.zeros(len(passages), dtype=np.int64)
    every = np.arange(len(passages))
    for i in range(tall):
        now = np.maximum(row[:, :-1] + np.where(text == item[:, i : i + 1], match, mismatch), row[:, 1:] + gap)
        now = np.maximum(now, 0.0)
        # along the row: the best earlier cell less the gaps since
        now = np.maximum.accumulate(now - slope, axis=1) + slope
        row[:, 1:] = now
        at = now.argmax(axis=1)
        better = now[every, at] > best
        best[better], end[better] = now[every, at][better], at[better]
    return best, end


def _passages(words: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(item, seeds, from, to) of the stretches of a text to align: runs of an item's seed hits on one diagonal band."""
    grams = _grams(words, seeds.n)
    if len(grams) and len(seeds.keys):
        at = np.searchsorted(seeds.keys, grams)
        at[at == len(seeds.keys)] = 0
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in np.flatnonzero(seeds.keys[at] == grams).tolist():
            for x in range(seeds.first[at[p]], seeds.first[at[p] + 1]):
                hits[int(seeds.item[x])].append((p, int(seeds.place[x])))
        for k, own in hits.items():
            size, need = seeds.size(k), seeds.need[k]
            run: list[tuple[int, int]] = []
            for p, q in [*sorted(own), (1 << 60, 0)]:
                if run and p - run[-1][0] > size:
                    if len({x for x, _ in run}) >= need:
                        # split what is longer than the item could be aligned with
                        begin = min(x - y for x, y in run) - size // 4 - 2
                        finish = max(x - y for x, y in run) + size + size // 4 + 2
                        yield k, len({x for x, _ in run}), max(0, begin), min(len(words), max(finish, run[-1][0] + seeds.n))
                    run = []
                run.append((p, q))
    for width, (keys, items) in seeds.short.items():
        grams, places = np.unique(_grams(words, width), return_index=True)
        low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
        for g in np.flatnonzero(high > low).tolist():
            for k in items[low[g] : high[g]].tolist():
                yield k, 1, int(places[g]), int(places[g]) + width


def _aligned(texts: list[np.ndarray], seeds: Seeds, threshold: float) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(text, item, seeds, score, first word, end) of the passages that score at least the threshold."""
    todo = [(d, k, n, a, words[a:b]) for d, words in enumerate(texts) for k, n, a, b in _passages(words, seeds)]
    todo.sort(key=lambda x: (len(x[4]), seeds.size(x[1])))
    while todo:  # batches of similar lengths, of bounded size
        longest = max(64, len(todo[-1][4]))
        now, todo = todo[-max(1, 400_000 // longest) :], todo[: -max(1, 400_000 // longest)]
        items = [seeds.text(x[1]) for x in now]
        best, end = align([x[4] for x in now], items)
        share = best / np.array([len(i) for i in items])
        good = np.flatnonzero(share >= threshold).tolist()
        if good:  # the start is where the reversed alignment ends
            _, back = align([now[g][4][: end[g] + 1][::-1] for g in good], [items[g][::-1] for g in good])
            for g, s in zip(good, back.tolist()):
                d, k, n, a, _ = now[g]
                yield d, k, n, float(share[g]), a + int(end[g] - s), a + int(end[g]) + 1


def _texts(column) -> list[np.ndarray]:
    """The word hashes of each text; null ones have none."""
    split = [words_of(t.as_py()) if t.is_valid else [] for t in column.cast(pa.string())]
    flat, ends = _hashes([w for t in split for w in t]), np.cumsum([len(t) for t in split])
    return [flat[e - len(t) : e] for t, e in zip(split, ends)]


def _at_once(paths: list[str], most: int = 4) -> int:
    """Bytes of texts for a pass over the seed tables: more once they are too many to be kept and are read again for each slice."""
    return _SLICE if len(paths) <= most else 4 * _SLICE * min(8, len(paths))


def _tables(paths: list[str], most: int = 4):
    """A function that gives the seed tables of the files, of which a task holds ``most`` at once."""
    held: dict[str, Seeds] = {}

    def load(path: str) -> Seeds:
        if path not in held:
            if len(held) >= most:
                held.clear()
            system, inner = pafs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as file:
                held[path] = Seeds(**pickle.loads(file.read()))
        return held[path]

    return lambda: map(load, paths)


def _scan(paths: list[str], threshold: float):
    names = ["doc", "item_id", "seeds", "score", "start_word", "end_word"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(paths)
        for part in text_slices(batches, "t", _at_once(paths)):
            texts, docs = _texts(part.column("t")), part.column("i").to_pylist()
            rows = [(docs[d], seeds.ids[k], *x) for seeds in tables() for d, k, *x in _aligned(texts, seeds, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)

    return run


def _clean(paths: list[str], threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(paths)
        for part in text_slices(batches, text_col, _at_once(paths)):
            texts, clean = _texts(part.column(text_col)), np.ones(part.num_rows, dtype=bool)
            for seeds in tables():
                left = np.flatnonzero(clean)
                clean[left[[d for d, *_ in _aligned([texts[i] for i in left], seeds, threshold)]]] = False
            yield part.filter(pa.array(clean))

    return run


def _distinct_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()


def shared_grams(items: DataFrame, id_col: str, text_col: str, n: int, most_items: int) -> DataFrame:
    """``(h)``: the hashes of word ``n``-grams that more than ``most_items`` of all items hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "t", _SLICE):
            grams = [np.unique(_grams(_hashes(words_of(t.as_py())), n)) for t in part.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64))], ["h"])

    rows = _distinct_items(items, id_col, text_col).mapInArrow(run, "h long")
    return rows.groupBy("h").count().where(F.col("count") > most_items).select("h")


def _shared_in(block: list[tuple[int | None, str]], shared: DataFrame, n: int) -> np.ndarray:
    """Those of ``shared`` that the block's items hold, sorted, so the driver has no more of them than the block has."""
    own = np.unique(np.concatenate([_grams(_hashes(words_of(t)), n) for _, t in block])).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(np.isin(part.column("h").to_numpy(), own)))

    return np.array(sorted(r.h % (1 << 64) for r in shared.mapInArrow(run, "h long").collect()), dtype=np.uint64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about ``block_bytes`` of text: what the driver holds at once, whatever their number."""
    block, held = [], 0
    for r in _distinct_items(items, id_col, text_col).orderBy("i", "t").toLocalIterator():
        if held and held + len(r.t) * 2 > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += len(r.t) * 2
    if block:
        yield block


def seed_files(items: DataFrame, id_col: str, text_col: str, n: int, most_items: int, least_seeds: int, threshold: float, block_bytes: int) -> list[str]:
    """Write the items' seed tables, one of at most about ``block_bytes`` of text at a time, to the shared folder; returns the paths."""
    folder = f"{shared_dir(items.sparkSession)}/seeds-{uuid.uuid4().hex}"
    shared, paths = staged(shared_grams(items, id_col, text_col, n, most_items), "shared-grams"), []
    for block in item_blocks(items, id_col, text_col, block_bytes):
        table = seed_table(block, n, _shared_in(block, shared, n), least_seeds, threshold)
        system, top = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(top, recursive=True)
        with system.open_output_stream(f"{top}/{len(paths):05d}") as file:
            file.write(pickle.dumps(vars(table)))
        paths.append(f"{folder if '://' in folder else 'file://' + folder}/{len(paths):05d}")
    discard(shared)
    return paths


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, most_items: int = 3, least_seeds: int = 2, threshold: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """``(id_col, item_id, seeds, score, start_word, end_word)``: the best alignment of each text with each item it holds.

    score is the alignment's score over that of a perfect copy (1 a matching word, -1 a replaced, extra or
    missing one); pairs below ``threshold`` are not returned. Seeds are word ``n``-grams; those in more than
    ``most_items`` of all items are dropped where an item has enough others (see ``seed_table``). One pass over the texts, without a
    shuffle of them, meets all items: their seed tables are files of ``block_bytes`` of text each, of which a task
    holds a few at once. The result doesn't depend on ``block_bytes``. Null texts and null items match nothing; null ids of documents and of items
    are returned as null, as one id; repeated rows of one id are one result; an empty table gives an empty result.
    """
    kinds = "item_id long, seeds long, score double, start_word long, end_word long"
    paths = seed_files(items, item_id, item_text, n, most_items, least_seeds, threshold, block_bytes)
    if not paths:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, {kinds}")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(_scan(paths, threshold), f"doc long, {kinds}")
    best = F.max(F.struct("score", "seeds", (-F.col("start_word")).alias("s"), "end_word")).alias("b")
    return found.groupBy("doc", "item_id").agg(best).select(F.col("doc").alias(id_col), "item_id", "b.seeds", "b.score", (-F.col("b.s")).alias("start_word"), "b.end_word")


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, most_items: int = 3, least_seeds: int = 2, threshold: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds a copy, exact or edited, of an item (see ``matches``).

    Every row is judged by its own text as it streams by, so there is no join: null and repeated ids are rows like others.
    """
    paths = seed_files(items, item_id, item_text, n, most_items, least_seeds, threshold, block_bytes)
    return docs.mapInArrow(_clean(paths, threshold, text_col), docs.schema) if paths else docs
