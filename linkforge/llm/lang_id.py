"""Language identification by a linear-chain conditional random field over words.

Words are labelled with languages; each word's score for a language sums the learned weights
of its hashed affix, character n-gram and lexicon features, and learned transitions tie
neighbours, so that single foreign words and code-switched stretches are told apart. Forward-backward
gives each word's marginals; a document takes the language with the largest mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import column_of, local_rows, text_slices

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of texts that are labelled at once; words and their letters whose scores a task keeps. A worker's memory follows these, not its batch's size.
_SLICE = 1 << 18
_KEPT_WORDS, _KEPT_LETTERS = 100_000, 2 << 20
_TEXT = "text to be labelled"
_U = np.uint64


def words_of(text: str) -> list[str]:
    """The letter runs of a text, lower-cased."""
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def feature_ids(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hashed feature of ``words``: prefixes and suffixes of 1 to 3 letters, 2- and 3-grams between boundary marks."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    codes = np.frombuffer((" ".join(f" {w}" for w in words) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64) if words else np.zeros(0, dtype=np.uint64)
    # each word takes its letters and a blank on either side
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    end = start + sizes
    rows, ids = [], []

    def add(kind: int, owners: np.ndarray, key: np.ndarray) -> None:
        rows.append(owners)
        ids.append(_mix(_mix(key + _U(1)) + _U(kind)) >> _U(64 - bits))

    place = np.arange(len(codes))
    for n in (2, 3):
        ok = np.flatnonzero(place + n <= end[owner]) if len(words) else place
        key = np.zeros(len(ok), dtype=np.uint64)
        for i in range(n):
            key = key * _U(0x110000) + codes[ok + i]
        add(n, owner[ok], key)
    for n in (1, 2, 3):
        has = np.flatnonzero(sizes - 2 >= n)
        pre, suf = np.zeros(len(has), dtype=np.uint64), np.zeros(len(has), dtype=np.uint64)
        for i in range(n):
            pre = pre * _U(0x110000) + codes[start[has] + 1 + i]
            suf = suf * _U(0x110000) + codes[end[has] - 2 - i]
        add(10 + n, has, pre)
        add(20 + n, has, suf)
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64)


@dataclass
class Crf:
    """Learned weights; labels in code point order."""

    labels: list[str]
    bits: int
    weights: np.ndarray  # (2**bits, labels)
    lexicon: dict[str, np.ndarray]  # word -> log-ratio of its frequency in each language
    lexicon_weight: np.ndarray  # (labels,)
    bias: np.ndarray
    transitions: np.ndarray  # (labels, labels), log

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-potential of each label for each word."""
        out = np.tile(self.bias, (len(words), 1)).astype(np.float64)
        if words:
            rows, ids = feature_ids(words, self.bits)
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(rows, weights=self.weights[ids, k], minlength=len(words))
            for i, w in enumerate(words):
                if (known := self.lexicon.get(w)) is not None:
                    out[i] += known * self.lexicon_weight
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = 64) -> np.ndarray:
    """Forward-backward marginals of the labels of all words of several sequences laid end to end.

    Exact, and vectorised over blocks: first each block's product of transition and score
    matrices, then the messages between the blocks of a sequence, then the words of all blocks at once.
    """
    n, k = scores.shape
    out = np.zeros((n, k))
    lengths = np.asarray(lengths)
    lengths_full = lengths[lengths > 0]
    if not n:
        return out
    starts = np.cumsum(lengths_full) - lengths_full
    blocks = -(-lengths_full // block)
    n_blocks = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    inside = np.arange(n_blocks) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + block * inside
    size = np.minimum(block, np.repeat(starts + lengths_full, blocks) - at)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    head = np.full((k, k), 1.0 / k)  # a sequence's first word has no neighbour before it
    is_first = inside == 0
    width = int(size.max())

    def step(matrix: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(size > t)
        return live, emit[at[live] + t]

    # products of the blocks
    product = np.tile(np.eye(k), (n_blocks, 1, 1))
    for t in range(width):
        live, e = step(product, t)
        now = product[live] @ move
        if t == 0:
            now[is_first[live]] = head
        now *= e[:, None, :]
        product[live] = now / now.sum(axis=(1, 2), keepdims=True)
    # messages into each block from before and after
    before, after = np.full((n_blocks, k), 1.0 / k), np.full((n_blocks, k), 1.0 / k)
    for j in range(1, int(blocks.max())):
        own = first[blocks > j] + j
        v = np.einsum("ni,nij->nj", before[own - 1], product[own - 1])
        before[own] = v / v.sum(axis=1, keepdims=True)
    last = first + blocks - 1
    for j in range(1, int(blocks.max())):
        own = last[blocks > j] - j
        v = np.einsum("nij,nj->ni", product[own + 1], after[own + 1])
        after[own] = v / v.sum(axis=1, keepdims=True)
    # words
    alpha = np.zeros((n, k))
    a = before
    for t in range(width):
        live, e = step(a, t)
        now = a[live] @ move
        if t == 0:
            now[is_first[live]] = 1.0 / k
        now *= e
        now /= now.sum(axis=1, keepdims=True)
        a = a if t else a.copy()
        a[live] = now
        alpha[at[live] + t] = now
    b = after.copy()
    for t in range(width - 1, -1, -1):
        live, e = step(b, t)
        now = alpha[at[live] + t] * b[live]
        out[at[live] + t] = now / now.sum(axis=1, keepdims=True)
        back = (e * b[live]) @ move.T
        b[live] = back / back.sum(axis=1, keepdims=True)
    return out


def _switched(texts: list[tuple[str, str]], labels: list[str], length: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Training sequences of ``length`` words and their labels: stretches of the texts, half of them put next to another language's."""
    stretches: dict[str, list[list[str]]] = {x: [] for x in labels}
    for text, lang in texts:
        words, at = words_of(text), 0
        while at < len(words):
            n = int(rng.integers(length // 4, length + 1))
            stretches[lang].append(words[at : at + n])
            at += n
    words, tags = [], []
    pools = {x: [s[i] for i in rng.permutation(len(s))] for x, s in stretches.items()}
    live = [x for x in labels if pools[x]]
    lang = live[0] if live else None
    while live:
        if lang not in live or rng.random() < 0.5:
            lang = live[int(rng.integers(len(live)))]
        part = pools[lang].pop()
        if not pools[lang]:
            live.remove(lang)
        words += part
        tags += [labels.index(lang)] * len(part)
    return words, np.array(tags, dtype=np.int64)


def fit(texts: list[tuple[str, str]], bits: int = 16, lexicon_size: int = 2000, length: int = 32, epochs: int = 4, rate: float = 0.3, seed: int = 11) -> Crf:
    """Fit by AdaGrad on the log-likelihood of code-switched sequences made from ``(text, language)`` pairs."""
    labels = sorted({lang for _, lang in texts})
    k = len(labels)
    rng = np.random.default_rng(seed)
    words, tags = _switched(texts, labels, length, rng)
    seen: dict[str, np.ndarray] = {}
    for w, t in zip(words, tags.tolist()):
        if w not in seen:
            seen[w] = np.zeros(k)
        seen[w][t] += 1
    share = np.maximum(np.bincount(tags, minlength=k), 1) if len(tags) else np.ones(k)
    common = sorted(seen, key=lambda w: (-seen[w].sum(), w))[:lexicon_size]
    lexicon = {}
    for w in common:
        rates = np.log((seen[w] + 0.5) / share)
        lexicon[w] = rates - rates.mean()
    model = Crf(labels, bits, np.zeros((1 << bits, k)), lexicon, np.zeros(k), np.zeros(k), np.zeros((k, k)))
    if k < 2:
        return model
    vocab = sorted(seen)
    index = {w: i for i, w in enumerate(vocab)}
    rows, ids = feature_ids(vocab, bits)
    order = np.argsort(rows, kind="stable")
    ids = ids[order]
    spans = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(vocab)))])
    lex = np.array([lexicon.get(w, np.zeros(k)) for w in vocab])
    tokens = np.array([index[w] for w in words])
    params = [model.weights, model.lexicon_weight, model.bias, model.transitions]
    squares = [np.full(p.shape, 1e-2) for p in params]
    n_seq = len(tokens) // length
    tokens, tags = tokens[: n_seq * length].reshape(-1, length), tags[: n_seq * length].reshape(-1, length)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n_seq), max(1, n_seq // 32)):
            if not len(batch):
                continue
            tok, tag = tokens[batch].ravel(), tags[batch].ravel()
            used, back = np.unique(tok, return_inverse=True)
            counts = spans[used + 1] - spans[used]
            flat = ids[np.repeat(spans[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            owner = np.repeat(np.arange(len(used)), counts)
            score = model.bias + lex[used] * model.lexicon_weight
            for j in range(k):
                score[:, j] += np.bincount(owner, weights=model.weights[flat, j], minlength=len(used))
            full = score[back].reshape(len(batch), length, k)
            unary, pair = _expected(full, model.transitions)
            unary = unary.reshape(-1, k)
            unary[np.arange(len(tag)), tag] -= 1.0
            was = tag.reshape(len(batch), length)
            np.add.at(pair, (was[:, :-1].ravel(), was[:, 1:].ravel()), -1.0)
            by_word = np.stack([np.bincount(back, weights=unary[:, j], minlength=len(used)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(flat, weights=by_word[owner, j], minlength=1 << bits) for j in range(k)], axis=1)
            grads = [grad, (by_word * lex[used]).sum(axis=0), by_word.sum(axis=0), pair]
            for p, s, g in zip(params, squares, grads):
                g /= len(batch)
                s += g * g
                p -= rate * g / np.sqrt(s)
    return model


def _expected(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected label counts (sequence, place, label) and summed transition counts under the model."""
    n, length, k = scores.shape
    emit, move = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    a, b = np.empty_like(emit), np.empty_like(emit)
    a[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a[:, t] = (a[:, t - 1] @ move) * emit[:, t]
        a[:, t] /= a[:, t].sum(axis=1, keepdims=True)
    b[:, -1] = 1.0
    for t in range(length - 2, -1, -1):
        b[:, t] = (emit[:, t + 1] * b[:, t + 1]) @ move.T
        b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
    unary = a * b
    unary /= unary.sum(axis=2, keepdims=True)
    pair = np.einsum("nti,ij,ntj->ntij", a[:, :-1], move, emit[:, 1:] * b[:, 1:])
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return unary, pair.sum(axis=(0, 1))


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int, max_words: int, seed: int = 5) -> list[tuple[str, str]]:
    """The ``per_language`` distinct texts of each language with the smallest hashes, whole; of them texts are taken until ``max_words`` letter runs a language are reached.

    Hashes under a bound are collected that leaves about four times as many of each language, judged by its number of rows; if copies
    leave some language short, its bound is raised. So no task sorts a language's rows. The driver collects those hashes and per_language texts
    for each language, nothing else. Languages with no letters in any text are left out.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    texts = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col), F.lit(seed)).alias("h"))
    open_ = {r.lang: min(1.0, 4 * per_language / r["count"]) for r in texts.groupBy("lang").count().collect()}
    found: dict[str, list[int]] = {}
    while open_:
        bounds = local_rows(texts.sparkSession, [(x, round(p * (1 << 62))) for x, p in open_.items()], "lang string, bound long")
        few = texts.select("lang", "h").join(F.broadcast(bounds) if len(open_) <= 10_000 else bounds, "lang").where(F.shiftrightunsigned("h", 2) <= F.col("bound")).select("lang", "h").distinct()
        own: dict[str, list[int]] = {x: [] for x in open_}
        for r in few.collect():
            own[r.lang].append(r.h)
        # unsigned order, as the bound is on the unsigned hash
        found |= {x: sorted(h, key=lambda v: v % (1 << 64))[:per_language] for x, h in own.items()}
        open_ = {x: min(1.0, 16 * p) for x, p in open_.items() if p < 1.0 and len(found[x]) < per_language}
    wanted = [(x, h) for x, own in found.items() for h in own]
    if not wanted:
        return []
    table = local_rows(texts.sparkSession, wanted, "lang string, h long")
    rows = texts.join(F.broadcast(table) if len(wanted) <= 1_000_000 else table, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).collect()
    out, held = [], {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        if held.get(r.lang, 0) < max_words:
            held[r.lang] = held.get(r.lang, 0) + len(words_of(r.text))
            out.append((r.text, r.lang))
    return out


def _label(model: Crf, path: str):
    """Labels the texts of a column or struct field; all columns but the text's own, if it was only sent for that, go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: dict[str, int] = {}
        table, letters = np.zeros((0, len(model.labels))), 0
        for part in text_slices(batches, path, _SLICE):
            if len(vocab) > _KEPT_WORDS or letters > _KEPT_LETTERS:
                vocab, table, letters = {}, table[:0].copy(), 0
            docs = [words_of(t.as_py()) if t.is_valid else [] for t in column_of(part, path)]
            fresh = list(dict.fromkeys(w for d in docs for w in d if w not in vocab))
            vocab.update(zip(fresh, range(len(vocab), len(vocab) + len(fresh))))
            table, letters = np.concatenate([table, model.scores(fresh)]), letters + sum(map(len, fresh))
            lengths = np.array([len(d) for d in docs])
            ids = np.fromiter((vocab[w] for d in docs for w in d), dtype=np.int64, count=int(lengths.sum()))
            gamma = marginals(table[ids], lengths, model.transitions)
            best = gamma.argmax(axis=1)
            ends = np.cumsum(lengths)
            sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)])
            mean = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)[:, None]
            switch = np.concatenate([[0], np.cumsum(np.append(best[1:] != best[:-1], False))]) if len(best) else np.zeros(1, dtype=np.int64)
            switches = np.where(lengths > 0, switch[np.maximum(ends - 1, 0)] - switch[ends - lengths], 0)
            pick = mean.argmax(axis=1)
            langs = [model.labels[p] if n else UNDETERMINED for p, n in zip(pick.tolist(), lengths.tolist())]
            score = np.clip(np.where(lengths > 0, mean[np.arange(len(docs)), pick], 0.0), 0.0, 1.0)
            kept = [c for c in part.schema.names if c != _TEXT]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(langs), pa.array(score), pa.array(lengths, pa.int64()), pa.array(switches, pa.int64())], [*kept, "lang_pred", "score", "n_letter_runs", "n_switches"])

    return run


def predict(docs: DataFrame, model: Crf, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``lang_pred, score, n_letter_runs, n_switches`` for every whole text.

    lang_pred is the label with the largest mean marginal and score that mean; null texts and texts
    without letters get ``und`` and score 0. Ties go to the first label in code point order.
    With no training text at all there are no labels, and every text gets ``und``. Repeated rows are kept;
    carried columns may have any name but those of the new ones. A text that is carried, or a field of a struct that is
    (``column.field``), is sent once.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    new = "lang_pred string, score double, n_letter_runs long, n_switches long"
    if not model.labels:
        return docs.select(*carry, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_letter_runs"), F.lit(0).cast("long").alias("n_switches"))
    if text_col.split(".")[0] in carry:
        return docs.select(*carry).mapInArrow(_label(model, text_col), f"{kinds}, {new}")
    return docs.select(*carry, F.col(text_col).cast("string").alias(_TEXT)).mapInArrow(_label(model, _TEXT), f"{kinds}, {new}")


def held_out(id_col: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves the remainder 1 by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, max_words: int = 40_000, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Fit on the rows that aren't held out, predict every row.

    The classifier is fitted on a bounded sample: at most ``per_language`` texts, and about
    ``max_words`` words, of each language. Returns ``carry`` (by default the id), ``held_out``
    and the columns of ``predict``.
    """
    train = docs.where(~held_out(id_col))
    model = fit(labelled_sample(train, text_col, lang_col, per_language, max_words))
    carry = (id_col,) if carry is None else carry
    rows = docs.withColumn("held_out", held_out(id_col))
    return predict(rows, model, text_col, (*carry, "held_out"))
