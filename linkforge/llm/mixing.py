"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's words lie on a line, in a seeded order of its documents, cut into blocks of equally many
words. Highest quotients give every source an integer quota of blocks, and every output
shard its own quotas, since awards in order of quotient can be dealt to shards as they come. Which
blocks a quota takes is a seeded permutation of the block numbers, so no block list is ever held.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import local_rows, n_words, staged

WEIGHTS = (5, 2, 1)
#: A source whose target is fewer common blocks than this is cut into finer ones of its own.
_LEAST_BLOCKS = 512
#: The source table is broadcast up to this many rows, and joined by shuffle beyond.
_BROADCAST_ROWS = 10_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Word targets that share ``share`` of all sizes by the (repeating) weights; what exceeds ``most`` times a size is reshared."""
    wish = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(wish[i] for i in open_)
        full = {i for i in open_ if left * wish[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * wish[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients weight/(2k+1), ties to the earlier entry, none above its cap.

    A bisection on the quotient awards all but a few seats at once, so the cost doesn't grow with their number.
    """
    caps = [seats] * len(weights) if caps is None else caps
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))

    def won(least: float) -> list[int]:
        return [min(c, int((w / least + 1) / 2)) if w > 0 else 0 for w, c in zip(weights, caps)]

    low, high = 0.0, max(weights, default=0.0) * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if sum(won(mid)) <= seats else (mid, high)
    out = won(high) if seats else [0] * len(weights)
    queue = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights, out, caps)) if w > 0 and k < c]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    blocks: int  # equal parts that the source's line of words is cut into
    quota: int  # blocks taken, repeats counted
    step: int  # block b is number (b*step + shift) mod blocks in the order of selection
    shift: int
    fine: bool = False  # the source has blocks of its own width


def plan_sources(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, blocks: int = 1 << 17, seed: int = 3) -> list[SourcePlan]:
    """The quota and block order of each source; sources by code point, null last.

    Sources with a target of fewer than ``_LEAST_BLOCKS`` blocks have as many blocks of their own width, or one a
    word, and a quota by their own target, so a small source beside large ones is mixed as exactly as they are.
    """
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in sizes], weights, share, most)
    width = max(1.0, sum(goal) / blocks)
    fine = [t < _LEAST_BLOCKS * width for t in goal]
    parts = [max(1, round(n / (max(1.0, t / _LEAST_BLOCKS) if f else width))) if n else 0 for (_, n), t, f in zip(sizes, goal, fine)]
    parts = [min(p, max(1, (1 << 62) // max(n, 1))) for p, (_, n) in zip(parts, sizes)]  # place times blocks stays below 2**63
    caps = [int(most * p) for p in parts]
    coarse = [0.0 if f else t for t, f in zip(goal, fine)]
    quotas = sainte_lague(coarse, round(sum(coarse) / width), caps)
    quotas = [min(c, round(t * p / n)) if f and n else q for (_, n), t, p, q, c, f in zip(sizes, goal, parts, quotas, caps, fine)]
    out = []
    for i, ((source, n), t, p, q) in enumerate(zip(sizes, goal, parts, quotas)):
        step = max(1, int(p * 0.6180339887498949))
        while p and gcd(step, p) > 1:
            step += 1
        out.append(SourcePlan(source, n, t, p, q, step, (seed * 2654435761 + i * 40503) % max(p, 1), fine[i]))
    return out


def shard_quotas(plans: list[SourcePlan], shards: int) -> list[list[int]]:
    """Blocks of each source in each shard: the awards in order of quotient, dealt to shards in turn of equal runs; sums to the quotas.

    Sources with finer blocks are dealt evenly by themselves, as a block of theirs isn't worth a common one.
    """
    targets_, caps = [0.0 if p.fine else p.target for p in plans], [0 if p.fine else p.quota for p in plans]
    seats = sum(caps)
    sums = [sainte_lague(targets_, seats * s // shards, caps) for s in range(shards + 1)]
    sums = [[p.quota * s // shards if p.fine else x for p, x in zip(plans, own)] for s, own in enumerate(sums)]
    return [[b - a for a, b in zip(x, y)] for x, y in zip(sums, sums[1:])]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, blocks: int = 1 << 17, seed: int = 3, carry: list[str] | None = None, rows_a_bucket: int = 256) -> DataFrame:
    """``carry`` columns (by default all) with ``size, source_size, target, taken`` of every row.

    size counts words, null text none; taken is how many of the row's words, repeats counted, lie in taken
    blocks, at most ``most`` times its size. A source's rows are ordered by classes of sizes and hashes of id and
    text, so reruns agree; rows equal in both are interchangeable. Null sources are one
    source, the last; null ids are ids like others; an empty table gives an empty result; columns of
    ``docs`` named like new ones are replaced. The driver collects one row a source.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {"size", "source_size", "target", "taken"}]
    rows = _taken(docs, keep, carry is not None, id_col, text_col, source_col, weights, share, most, blocks, seed, rows_a_bucket)
    return rows.select(*(F.col("carry")[c].alias(c) for c in keep), "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, keep: list[str], stage: bool, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, blocks: int, seed: int, rows_a_bucket: int) -> DataFrame:
    """The rows of ``mix``, ``keep`` packed into one column, with the number of their source, their bucket on its line, and their order in it.

    A bucket holds rows of one source with sizes of a class (within a factor of 2 of each other), dealt by a hash of id and text; there are as many of a
    class as give about ``rows_a_bucket`` rows at most, up to 65,536. Classes go from the largest down; rows are ordered by size in a bucket, down and up in turn.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(F.struct(*(F.col(c) for c in keep)).alias("carry"), F.col(source_col).cast("string").alias("source"), n_words(text).cast("long").alias("size"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("h"))
    if stage:
        base = staged(base, "sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    plans = plan_sources([(r.source, r["size"]) for r in totals], weights, share, most, blocks, seed)
    many = {r.source: min(1 << 16, -(-r.n // rows_a_bucket)) for r in totals}
    table = local_rows(spark, [(p.source, i, p.size, p.target, p.blocks, p.quota // max(p.blocks, 1), p.quota % max(p.blocks, 1), p.step, p.shift, many[p.source]) for i, p in enumerate(plans)], "s string, ix int, source_size long, target double, n long, full long, rest long, step long, shift long, many long")
    if len(plans) <= _BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = base.join(table, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("bucket", F.expr("(64 - length(bin(size))) * 65536L + pmod(h, many)")).withColumn("by", F.expr("if(pmod(bucket, 2) = 0, -size, size)"))
    # a row's place on its source's line: the buckets before its own, then the rows before it there
    sums = rows.groupBy("ix", "bucket").agg(F.sum("size").alias("sum"))
    offsets = sums.select("ix", "bucket", F.expr("sum(sum) over (partition by ix order by bucket) - sum").alias("offset"))
    placed = rows.withColumn("in", F.expr("sum(size) over (partition by ix, bucket order by by, h rows between unbounded preceding and current row) - size"))
    placed = placed.join(offsets, ["ix", "bucket"]).withColumn("p", F.col("offset") + F.col("in"))
    # block b holds the words from ceil(b*source_size/n); p*n stays below 2**63
    extra = F.expr(
        "aggregate(sequence(p * n div source_size, (p + size - 1) * n div source_size), 0L, (a, b) -> a + if(pmod(b * step + shift, n) < rest,"
        " least(p + size, ((b + 1) * source_size + n - 1) div n) - greatest(p, (b * source_size + n - 1) div n), 0L))"
    )
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("full") * F.col("size") + F.when(F.col("rest") > 0, extra).otherwise(F.lit(0).cast("long")))
    return placed.select("carry", "size", "source_size", "target", taken.alias("taken"), "ix", "bucket", "by", "h")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, blocks: int = 1 << 17, seed: int = 3, rows_a_bucket: int = 256) -> DataFrame:
    """``docs``, whole rows of a mix, all their columns; wordless ones once.

    A document of a share taken/size is due that many copies. The shares are summed along the source's line,
    and a document has as many copies as the sum, rounded to a whole number, grows by with it: its share rounded down or up, whatever its length.
    The line goes from long documents to short ones, so one that is left out is made up for by the next of about its
    size, and the source's words come near its target.
    """
    unit = 1 << 30  # integer shares, so that sums don't depend on their order
    rows = _taken(docs, docs.columns, False, id_col, text_col, source_col, weights, share, most, blocks, seed, rows_a_bucket)
    rows = rows.withColumn("due", F.expr(f"if(size = 0, 0L, (taken * {unit}L + size div 2) div size)"))
    sums = rows.groupBy("ix", "bucket").agg(F.sum("due").alias("sum"))
    starts = sums.select("ix", "bucket", F.expr(f"sum(sum) over (partition by ix order by bucket) - sum + {unit}L div 2").alias("start"))
    rows = rows.withColumn("to", F.expr("sum(due) over (partition by ix, bucket order by by, h rows between unbounded preceding and current row)")).join(starts, ["ix", "bucket"])
    times = F.expr(f"if(size = 0, 1, int((start + to) div {unit}L - (start + to - due) div {unit}L))")
    return rows.withColumn("times", times).where("times > 0").select("carry", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("carry.*")
