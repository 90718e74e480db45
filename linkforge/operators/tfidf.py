"""Character TF-IDF top-K similarity joins, sharded by country; and the pre-blocked address variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.config import LinkConfig
from linkforge.functions import text as T
from linkforge.sources.records import staged

ROUTES = {"postcode": 1, "postcode_prefix": 2, "numeric": 4, "rare_token": 8}


_U = np.uint64


def gram_counts(records: DataFrame, column: str, config: LinkConfig) -> DataFrame:
    """``(entity_id, country, gram, tf)`` by built-in functions alone."""
    grams = T.char_ngrams(F.col(column), *config.ngrams)
    return records.select("entity_id", F.col("country_norm").alias("country"), F.explode(grams).alias("gram")).groupBy("entity_id", "country", "gram").agg(F.count(F.lit(1)).alias("tf"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _grams(texts: list[str | None], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first code, length) of the n-grams of all words, each padded with a blank on both sides, and the codes."""
    if low > 3:
        raise ValueError("n-grams begin at 3 or less: a padded word has at least 3 characters")
    split = [[w for w in (t or "").split(" ") if w] for t in texts]
    words = [w for own in split for w in own]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    end = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.repeat(np.arange(len(texts)), [len(own) for own in split]), sizes)
    place, out = np.arange(len(codes)), []
    key = codes.copy()
    for n in range(1, high + 1):
        if n > 1:
            key = _mix(key[: len(codes) - n + 1]) * _U(0x110000) + codes[n - 1 :]
        if n >= low:
            ok = np.flatnonzero(place[: len(key)] + n <= end[: len(key)])
            out.append((owner[ok], _mix(key[ok] + _U(n)), ok, np.full(len(ok), n)))
    return *(np.concatenate(x) for x in zip(*out)), codes


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each run of equal keys in it), by the first key, then the next."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(fresh)


def packed_grams(records: DataFrame, column: str, config: LinkConfig) -> DataFrame:
    """``(id, country, g, tf)``: each record's distinct n-grams, as 64-bit hashes, with their counts in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, h, _, _, _ = _grams(batch.column("t").to_pylist(), *config.ngrams)
            order, first = _runs(text, h)
            own = order[first]
            offsets = pa.array(np.searchsorted(text[own], np.arange(batch.num_rows + 1)), pa.int32())
            tf = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("country"), pa.ListArray.from_arrays(offsets, pa.array(h[own].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], ["id", "country", "g", "tf"])

    rows = records.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("country"), F.col(column).alias("t"))
    return rows.mapInArrow(run, "id string, country string, g array<long>, tf array<int>")


def vocabulary(feed: DataFrame, column: str, config: LinkConfig) -> DataFrame:
    """``(country, h, gram, df, idf)`` of the feed shard, capped to the grams with the largest corpus frequency; h is the gram's hash.

    Each batch of records counts its grams before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("country").dictionary_encode()
            text, h, at, n, codes = _grams(batch.column("t").to_pylist(), *config.ngrams)
            country = shard.indices.to_numpy()[text]
            order, first = _runs(country, h, text)  # a run for each record, then for each gram
            own = order[first]
            tf = np.diff(np.append(first, len(order)))
            order, first = _runs(country[own], h[own])
            one = own[order[first]]
            df = np.diff(np.append(first, len(order)))
            total = np.add.reduceat(tf[order], first) if len(first) else tf
            letters = codes.astype("<u4")
            grams = [letters[a : a + k].tobytes().decode("utf-32-le", "surrogatepass") for a, k in zip(at[one].tolist(), n[one].tolist())]
            yield pa.RecordBatch.from_arrays([shard.dictionary.take(pa.array(country[one])), pa.array(h[one].view(np.int64)), pa.array(grams, pa.string()), pa.array(df, pa.int64()), pa.array(total, pa.int64())], ["country", "h", "gram", "df", "total"])

    rows = feed.select(F.col("country_norm").alias("country"), F.col(column).alias("t"))
    shards = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.mapInArrow(run, "country string, h long, gram string, df long, total long")
    out = counts.groupBy("country", "h").agg(F.min("gram").alias("gram"), F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= config.min_df)
    if config.max_features is not None:
        out = out.withColumn("place", F.expr("row_number() over (partition by country order by total desc, gram)")).where(F.col("place") <= config.max_features).drop("place")
    return out.join(shards, "country").select("country", "h", "gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def top_k(scores: DataFrame, k: int, prefix: str) -> DataFrame:
    """The k best of each query; similarities are rounded so that equal ones tie, then go by id."""
    order = "row_number() over (partition by source1_entity_id order by similarity desc, candidate_entity_id)"
    ranked = scores.withColumn("similarity", F.round("similarity", 9)).where("similarity > 0").withColumn("place", F.expr(order).cast("int")).where(F.col("place") <= k)
    return ranked.withColumnsRenamed({"similarity": f"{prefix}_similarity", "place": f"{prefix}_rank"})


#: Records of the index, and queries, that one group holds at most; with few queries, they are cut into up to _SPREAD blocks of _FEW.
_BLOCK_DOCS, _BLOCK_QUERIES, _SPREAD, _FEW = 50_000, 20_000, 16, 250
_SCORED = "source1_entity_id string, candidate_entity_id string, similarity double, route_mask int, pool_size int"


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a list column."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


def _weigh(rows: pa.Table, grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram's place in the vocabulary, weight) of all in-vocabulary grams: sublinear, L2-normalised over them."""
    ends, g = _flat(rows.column("g"))
    tf = _flat(rows.column("tf"))[1]
    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
    known = np.flatnonzero(grams[at] == g)
    row, at = np.repeat(np.arange(rows.num_rows), np.diff(ends))[known], at[known]
    w = (1 + np.log(tf[known])) * idf[at]
    return row, at, w / np.sqrt(np.bincount(row, w * w, rows.num_rows))[row]


def _largest(dots: np.ndarray, k: int) -> np.ndarray:
    """Places of positive values, among them all that belong to the k largest, or tie with those once rounded to 9 places.

    The k-th largest maximum of 8k stretches is no more than the k-th largest value, so hardly more than k are left.
    """
    width, bound = len(dots) // (8 * k), 0.0
    if width > 1:
        bound = np.partition(dots[: 8 * k * width].reshape(8 * k, width).max(axis=1), 7 * k)[7 * k] - 2e-9
    return np.flatnonzero(dots > max(bound, 0.0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs of ``sizes`` from ``starts``."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _score_block(k: int):
    """Top-k of each query within one block of records: postings of its grams summed in an array over the block.

    The row without an id is the country's vocabulary. A query with a list ``only`` is scored against those records alone, and returns their route masks;
    unless its postings are fewer, by the listed records' own grams, so its cost is that of the list and not of the block.
    """

    def run(key, left, right):
        rows: tuple[list, ...] = ([], [], [], [], [])
        vocab, docs = right.filter(right.column("id").is_null()), right.filter(right.column("id").is_valid())
        if left.num_rows and docs.num_rows and vocab.num_rows:
            grams, idf = _flat(vocab.column("g"))[1], _flat(vocab.column("idf"))[1]
            order = np.argsort(grams)
            grams, idf = grams[order], idf[order]
            doc, gram, weight = _weigh(docs, grams, idf)
            begin = np.searchsorted(doc, np.arange(docs.num_rows + 1))
            held, df = np.diff(begin), np.bincount(gram, minlength=len(grams))
            first, postings = np.concatenate([[0], np.cumsum(df)]), None
            names = docs.column("id").to_pylist()
            row, at, w = _weigh(left, grams, idf)
            ends = np.searchsorted(row, np.arange(left.num_rows + 1))
            only = left.column("only").combine_chunks()
            listed, upto = only.is_valid().to_numpy(zero_copy_only=False), only.offsets.to_numpy()
            places = pc.fill_null(pc.index_in(only.values.field("c"), value_set=docs.column("id").combine_chunks()), -1).to_numpy()
            routes = only.values.field("m").to_numpy(zero_copy_only=False)
            own_weight = np.zeros(len(grams))
            for i, (q, size) in enumerate(zip(left.column("id").to_pylist(), left.column("pool_size").to_pylist())):
                own = slice(ends[i], ends[i + 1])
                if ends[i] == ends[i + 1]:
                    continue
                near, mask = None, None
                if listed[i]:
                    near, mask = places[upto[i] : upto[i + 1]], routes[upto[i] : upto[i + 1]]
                    near, mask = near[near >= 0], mask[near >= 0]
                if near is not None and held[near].sum() <= df[at[own]].sum() + len(names):
                    own_weight[at[own]] = w[own]
                    one = _ranges(begin[near], held[near])
                    dots = np.bincount(np.repeat(np.arange(len(near)), held[near]), own_weight[gram[one]] * weight[one], len(near))
                    own_weight[at[own]] = 0
                else:
                    if postings is None:
                        order = np.argsort(gram, kind="stable")
                        postings = doc[order], weight[order]
                    spans = [slice(first[g], first[g + 1]) for g in at[own].tolist()]
                    dots = np.bincount(np.concatenate([postings[0][x] for x in spans]), np.concatenate([postings[1][x] * y for x, y in zip(spans, w[own].tolist())]), len(names))
                    near = _largest(dots, k) if near is None else near
                    dots = dots[near]
                dots = dots.round(9)
                kept = np.flatnonzero(dots > 0)
                if len(kept) > k:  # all that tie with the k-th stay
                    kept = kept[dots[kept] >= np.partition(dots[kept], len(kept) - k)[len(kept) - k]]
                best = sorted((-dots[x], names[near[x]], x) for x in kept.tolist())[:k]
                for column, values in zip(rows, ([q] * len(best), [x for _, x, _ in best], [-s for s, _, _ in best], [0 if mask is None else mask[x] for *_, x in best], [size] * len(best))):
                    column += values
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(rows, kinds)], names=[x.split(" ")[0] for x in _SCORED.split(", ")])

    return run


def _block(name: str, many: str) -> F.Column:
    return F.pmod(F.xxhash64(name), F.col(many))


def _sizes(source: DataFrame, feed: DataFrame) -> DataFrame:
    """``(country, doc_blocks, query_blocks)`` of each country of the source, from its numbers of records."""
    count = lambda frame, name: frame.groupBy(F.col("country_norm").alias("country")).agg(F.count(F.lit(1)).alias(name))
    counts = count(feed, "docs").join(count(source, "queries"), "country")
    blocks = F.greatest(F.ceil(F.col("queries") / _BLOCK_QUERIES), F.least(F.lit(_SPREAD), F.ceil(F.col("queries") / _FEW)), F.lit(1))
    return counts.select("country", F.greatest(F.ceil(F.col("docs") / _BLOCK_DOCS), F.lit(1)).alias("doc_blocks"), blocks.alias("query_blocks"))


def _repeat(many: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))


def _meet(queries: DataFrame, feed: DataFrame, column: str, sizes: DataFrame, vocab: DataFrame, k: int, config: LinkConfig) -> DataFrame:
    """Scores of ``queries(id, country, g, tf, only, pool_size, q, d)`` against the feed records of block d of their country.

    A country's vocabulary, at most ``max_features`` grams, is one row that goes to each of its pairs of blocks.
    """
    keys = ["country", "q", "d"]
    none = F.lit(None)
    docs = packed_grams(feed, column, config).join(sizes, "country").withColumn("d", _block("id", "doc_blocks")).withColumn("q", _repeat("query_blocks"))
    docs = docs.select("id", "g", "tf", none.cast("array<double>").alias("idf"), *keys)
    one = vocab.groupBy("country").agg(F.collect_list(F.struct("h", "idf")).alias("v")).join(sizes, "country").withColumn("q", _repeat("query_blocks")).withColumn("d", _repeat("doc_blocks"))
    one = one.select(none.cast("string").alias("id"), F.col("v.h").alias("g"), none.cast("array<int>").alias("tf"), F.col("v.idf").alias("idf"), *keys)
    queries = queries.select("id", "g", "tf", "only", "pool_size", *keys)
    return queries.groupBy(*keys).cogroup(docs.unionByName(one).groupBy(*keys)).applyInArrow(_score_block(k), _SCORED)


def retrieve(source: DataFrame, feed: DataFrame, column: str, k: int, prefix: str, config: LinkConfig) -> DataFrame:
    """Top-K by TF-IDF cosine within the country.

    Every record is one packed row of gram counts. A country's feed and queries are cut into blocks by its own sizes; each pair of
    blocks meets in one task, which weighs them and returns only its top K, so no row is made for a gram or for a pair of records. A feed row travels once for
    each 20,000 queries of its country (at most 16 times for fewer), a query once for each 50,000 records.
    """
    kept = feed.where(F.col(column) != "")
    sizes = _sizes(source, kept)
    queries = packed_grams(source, column, config).join(sizes, "country").withColumn("q", _block("id", "query_blocks")).withColumn("d", _repeat("doc_blocks"))
    queries = queries.withColumns({"only": F.lit(None).cast("array<struct<c:string,m:int>>"), "pool_size": F.lit(0)})
    return top_k(_meet(queries, kept, column, sizes, vocabulary(kept, column, config), k, config).drop("route_mask", "pool_size"), k, prefix)


def address_keys(records: DataFrame, config: LinkConfig) -> DataFrame:
    """``(entity_id, country, route, key)`` of the pre-blocking routes."""
    none = F.array().cast("array<struct<route:string,key:string>>")
    code = F.col("postcode")
    tag = lambda name, keys: F.transform(keys, lambda t: F.struct(F.lit(name).alias("route"), t.alias("key")))
    parts = [F.when(code != "", tag("postcode", F.array(code))).otherwise(none)]
    parts.append(F.when(F.length(code) >= config.prefix_length, tag("postcode_prefix", F.array(code.substr(1, config.prefix_length)))).otherwise(none))
    parts.append(tag("numeric", F.array_distinct("address_numeric_tokens")))
    parts.append(tag("rare_token", T.informative(F.col("address_tokens"), config.min_token_length)))
    return records.select("entity_id", F.col("country_norm").alias("country"), F.explode(F.concat(*parts)).alias("k")).select("entity_id", "country", "k.*")


def address_pool(source: DataFrame, feed: DataFrame, config: LinkConfig, routes: tuple[str, ...] = ("postcode", "numeric", "rare_token")) -> DataFrame:
    """``(pair, route_mask, least_df)`` of the pairs that share a key of a route, capped a query by (routes desc, df, id)."""
    left, right = address_keys(source, config), address_keys(feed, config)
    df = right.groupBy("country", "route", "key").agg(F.count(F.lit(1)).alias("df"))
    limit = F.when(F.col("route") == "postcode_prefix", config.prefix_max_df).when(F.col("route") == "numeric", config.numeric_max_df).when(F.col("route") == "rare_token", config.rare_token_max_df).otherwise((1 << 31) - 1)
    probes = left.where(F.col("route").isin(*routes)).join(df, ["country", "route", "key"]).where(F.col("df") <= limit)
    # only the rarest lexical tokens of a query probe
    place = F.expr("row_number() over (partition by entity_id, route order by df, key)")
    probes = probes.withColumn("place", place).where((F.col("route") != "rare_token") | (F.col("place") <= config.rare_tokens_per_query))
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair)), F.col("route"))
    pairs = probes.select(F.col("entity_id").alias("source1_entity_id"), "country", "route", "key", "df").join(right.withColumnRenamed("entity_id", "candidate_entity_id"), ["country", "route", "key"])
    pool = pairs.groupBy("source1_entity_id", "candidate_entity_id").agg(F.bit_or(bit).alias("route_mask"), F.min("df").alias("least_df"))
    order = "row_number() over (partition by source1_entity_id order by bit_count(route_mask) desc, least_df, candidate_entity_id)"
    sized = pool.withColumn("pool_size", F.expr("count(*) over (partition by source1_entity_id)").cast("int"))
    return sized.withColumn("place", F.expr(order)).where(F.col("place") <= config.pool_cap).drop("place")


def fallback_pool(source: DataFrame, feed: DataFrame, pool: DataFrame, config: LinkConfig, vocab: DataFrame | None = None) -> DataFrame:
    """Pairs for the addresses without a pool: records that share one of their rarest grams, frequent grams only if there is no other; capped a query by (df, id)."""
    kept = feed.where("address_full <> ''")
    vocab = vocabulary(kept, "address_full", config) if vocab is None else vocab
    empty = source.where("address_full <> ''").join(pool.select(F.col("source1_entity_id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    own = packed_grams(empty, "address_full", config).select("id", "country", F.explode(F.arrays_zip("g", "tf")).alias("x")).select("id", "country", F.col("x.g").alias("h"), "x.tf")
    own = own.join(vocab, ["country", "h"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    own = own.withColumn("rare", (F.col("df") <= config.fallback_max_df).cast("int")).withColumn("any_rare", F.expr("max(rare) over (partition by id)")).where("rare = any_rare")
    picked = own.withColumn("place", F.expr("row_number() over (partition by id order by df, w desc, gram)")).where(F.col("place") <= config.fallback_features)
    picked = picked.select(F.col("id").alias("source1_entity_id"), "country", "h", "df")
    postings = packed_grams(kept, "address_full", config).select(F.col("id").alias("candidate_entity_id"), "country", F.explode("g").alias("h"))
    found = picked.join(postings, ["country", "h"]).groupBy("source1_entity_id", "candidate_entity_id").agg(F.min("df").alias("least_df"))
    sized = found.withColumn("pool_size", F.expr("count(*) over (partition by source1_entity_id)").cast("int"))
    order = "row_number() over (partition by source1_entity_id order by least_df, candidate_entity_id)"
    return sized.withColumn("place", F.expr(order)).where(F.col("place") <= config.pool_cap).drop("place")


def retrieve_preblocked(source: DataFrame, feed: DataFrame, config: LinkConfig, routes: tuple[str, ...] = ("postcode", "numeric", "rare_token"), fallback: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """Address TF-IDF top-K over the pool pairs only, with the routes that found each pair.

    A query travels to the blocks of the feed that hold some of its pool, with the list of those records, so no vector is sent for a pair.
    """
    kept = feed.where("address_full <> ''")
    vocab = staged(vocabulary(kept, "address_full", config)) if vocab is None else vocab
    pool = staged(address_pool(source, feed, config, routes).select("source1_entity_id", "candidate_entity_id", "route_mask", "pool_size"))
    if fallback:
        extra = fallback_pool(source, feed, pool, config, vocab).select("source1_entity_id", "candidate_entity_id", F.lit(16).alias("route_mask"), "pool_size")
        pool = pool.unionByName(extra)
    sizes = _sizes(source, kept)
    queries = packed_grams(source, "address_full", config).join(sizes, "country").withColumn("q", _block("id", "query_blocks"))
    # pairs are within a country, so the query's country tells the block of the candidate
    blocks = source.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("country")).join(sizes, "country").select("id", F.col("doc_blocks").alias("many"))
    own = pool.withColumnRenamed("source1_entity_id", "id").join(blocks, "id").withColumn("d", _block("candidate_entity_id", "many"))
    lists = own.groupBy("id", "d").agg(F.max("pool_size").alias("pool_size"), F.collect_list(F.struct(F.col("candidate_entity_id").alias("c"), F.col("route_mask").cast("int").alias("m"))).alias("only"))
    out = top_k(_meet(queries.join(lists, "id"), kept, "address_full", sizes, vocab, config.address_k, config), config.address_k, "address_tfidf")
    flags = {f"address_route_{name}": F.col("route_mask").bitwiseAND(F.lit(bit)).cast("boolean").cast("int") for name, bit in {**ROUTES, "country_fallback": 16}.items()}
    return out.withColumns(flags).withColumn("address_route_count", F.bit_count("route_mask"))
