"""Range sharding by sampled splitters.

Rows are ordered by (hash of the text, id, row number), so equal texts are neighbours. A size-weighted
key sample of bounded size gives quantile splitters; ranges that turn out overfull when measured are
subdivided by splitters sampled inside them. Each range is then laid out on the line of all bytes by its own keys only, and the
line is cut into equal shards. Only keys are sorted; the rows meet their places by row number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import staged

_FIRST = -(1 << 63)
#: Splitters are held by the driver and by every task: at most so many ranges, and some more where overfull ones are subdivided.
_MOST_RANGES = 16_384
Key = tuple[int, int, int]


def _longs(values: list[int]) -> F.Column:
    """A literal array; one string, so that the plan stays small however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _below(splitters: list[Key]) -> F.Column:
    """Number of splitters up to (h, i, r), by binary descent in literal arrays: small code, however many there are."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    hs, ids, rows = (_longs([s[k] for s in splitters]) for k in range(3))
    steps = F.lit([1 << b for b in range(n.bit_length() - 1, -1, -1)])

    def descend(count, step):
        h, i, r = (F.element_at(x, count + step) for x in (hs, ids, rows))
        before = (h < F.col("h")) | ((h == F.col("h")) & ((i < F.col("i")) | ((i == F.col("i")) & (r <= F.col("r")))))
        return F.when(F.when(count + step <= n, before).otherwise(F.lit(False)), count + step).otherwise(count)

    return F.aggregate(steps, F.lit(0), descend)


def sampled_splitters(keys: DataFrame, total: int, ranges: int, sample: int, seed: int) -> list[Key]:
    """Quantile boundaries of ``keys(h, i, r, size)``, with ``total`` bytes, from a size-weighted sample of about ``sample`` rows.

    A row is drawn with a chance proportional to its size (certainly, above total/sample). The
    sample is what the driver collects: its expected size is bounded by ``2 * sample``.
    """
    chance = F.least(F.lit(1.0), F.col("size") * (float(sample) / max(total, 1)))
    drawn = (F.xxhash64("h", "i", "r", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < chance
    weight = F.greatest(F.col("size").cast("double"), F.lit(max(total, 1) / sample))
    found = keys.where(drawn).select("h", "i", "r", weight.alias("w")).toArrow()
    h, i, r, w = (found.column(c).to_numpy() for c in ("h", "i", "r", "w"))
    order = np.lexsort((r, i, h))
    h, i, r, w = h[order], i[order], r[order], w[order]
    seen = np.concatenate([[0.0], np.cumsum(w)]) * (ranges / max(w.sum(), 1e-9))
    cuts = np.flatnonzero(seen[:-1].astype(np.int64) != seen[1:].astype(np.int64))
    # the first cut within one hash value is moved to its start: only hashes that fill several ranges are split
    same = np.concatenate([[False], h[cuts][1:] == h[cuts][:-1]]) if len(cuts) else np.zeros(0, dtype=bool)
    return sorted({(int(h[c]), int(i[c]), int(r[c])) if s else (int(h[c]), _FIRST, _FIRST) for c, s in zip(cuts, same)})


def measured_splitters(keys: DataFrame, total: int, ranges: int, sample: int, seed: int, overfull: float = 2.0) -> list[Key]:
    """``sampled_splitters``, and more of them inside each range of more than ``overfull`` times the even size, until none of several rows is left."""
    splitters, even, known = sampled_splitters(keys, total, ranges, sample, seed), total / ranges, set()
    while True:
        ends = [F.expr(f"{f}(struct(h, i, r))").alias(f) for f in ("min", "max")]
        sizes = keys.groupBy(_below(splitters).alias("range")).agg(F.sum("size").alias("s"), *ends).where((F.col("s") > overfull * even) & (F.col("min") != F.col("max"))).collect()
        fresh = [x for x in sizes if (x.min, x.max) not in known]
        if not fresh:
            return splitters
        known |= {(x.min, x.max) for x in fresh}
        seed += 1
        for x in fresh:
            low, high = (F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip("hir", end))) for end in (x.min, x.max))
            own = keys.where((F.struct("h", "i", "r") >= low) & (F.struct("h", "i", "r") <= high))
            pieces = int(x.s / even) + 1
            inner = sampled_splitters(own, x.s, pieces, 64 * pieces, seed)
            splitters += [s for s in inner if tuple(x.min) < s <= tuple(x.max)]
        splitters = sorted(set(splitters))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, sample: int | None = None, keep_whole: float = 0.01, seed: int = 7, carry: list[str] | None = None, rows_a_range: int = 500_000) -> DataFrame:
    """``docs`` (its columns ``carry``, by default all) with ``size, text_crc32, shard, slot``: shards of near equal bytes, slots gapless from 0 in each.

    size is the UTF-8 length of the text (null: none) plus 1; text_crc32 of a null text is 0.
    Rows with equal texts share a shard as long as together they hold at most ``keep_whole`` of an
    even shard; a larger group is cut where the line of bytes is cut. So a shard departs from the
    even size by at most that share, or by one document. Null ids sort first; repeated
    rows are kept; a column of ``docs`` named like one of the four is replaced; an empty table gives an empty result.
    The number of ranges grows with the rows, one a ``rows_a_range``, from 256 to 16,384; the driver collects 64 keys, and a row a shard, for each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {"size", "text_crc32", "shard", "slot"}]
    base = docs.select(
        F.struct(*(F.col(c) for c in keep)).alias("carry"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("i"), F.monotonically_increasing_id().alias("r"),
    )
    base = staged(base, "sharding-rows")  # from here on row numbers are fixed
    keys = base.select("r", "h", "i", "size")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(_MOST_RANGES, max(256, -(-n // rows_a_range)))
    splitters = measured_splitters(keys, total, ranges, sample or 64 * ranges, seed) if n else []
    whole = F.col("bytes") <= keep_whole * total / shards
    by_row = "partition by range order by h, i, r rows between unbounded preceding and 1 preceding"
    keys = keys.withColumn("range", _below(splitters))
    rows = keys.select("*", F.expr(f"coalesce(sum(size) over ({by_row}), 0)").alias("before"), F.expr("sum(size) over (partition by range, h)").alias("bytes"))
    rows = rows.withColumn("group_start", F.expr("min(before) over (partition by range, h)"))
    many = len(splitters) + 1
    sizes = {x.range: x.s for x in keys.groupBy("range").agg(F.sum("size").alias("s")).collect()}  # a row a range
    starts = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(many)])])[:many].tolist()
    place = F.element_at(_longs(starts), F.col("range") + 1) + F.when(whole, F.col("group_start") + F.col("bytes") / 2.0).otherwise(F.col("before") + F.col("size") / 2.0)
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(place * shards / float(max(total, 1)))).cast("int"))
    rows = rows.select("r", "range", "shard", (F.expr("row_number() over (partition by range, shard order by h, i, r)") - 1).alias("within"))
    rows = staged(rows, "shards")
    counts = np.zeros((many, shards), dtype=np.int64)
    for x in rows.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n")).collect():  # at most a row a range and shard
        counts[x["range"], x.shard] = x.n
    bases = (np.cumsum(counts, axis=0) - counts).ravel().tolist()
    slot = F.element_at(_longs(bases), F.col("range") * shards + F.col("shard") + 1) + F.col("within")
    rows = rows.select("r", "shard", slot.cast("long").alias("slot"))
    return base.select("r", "carry", "size", "text_crc32").join(rows, "r").select(*(F.col("carry")[c].alias(c) for c in keep), "size", "text_crc32", "shard", "slot")
