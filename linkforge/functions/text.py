"""Text canonicalisation: one Arrow UDF for Unicode folding, built-in functions for the rest."""

from __future__ import annotations

import difflib
import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: The suffix words that mark a legal form.
LEGAL_FORMS = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "llp", "ltd", "limited", "private", "pvt", "plc", "sa", "sas", "sarl", "eurl", "snc", "cie")
_NOT_WORD = r"[^\p{L}\p{N}_]+"
_SUFFIX = "(?:" + "|".join(LEGAL_FORMS) + ")"


def _fold(text: str) -> str:
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().strip())
    return "".join(c for c in folded if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded, without combining marks; equal texts of a batch are folded once."""
    known = {t: t.casefold().strip() if t.isascii() else _fold(t) for t in texts.dropna().unique()}
    return texts.map(known)


@F.pandas_udf(StringType())
def fold_country(texts: pd.Series) -> pd.Series:
    known = {t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in texts.dropna().unique()}
    return texts.map(known)


@F.pandas_udf(DoubleType())
def character_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of each pair, in this argument order; equal pairs of a batch are compared once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left, right):
        if pair not in seen:
            seen[pair] = 1.0 if pair[0] == pair[1] else difflib.SequenceMatcher(None, *pair, autojunk=False).ratio()
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def stable_fraction(ids: Column, seed: int) -> Column:
    """A fixed place of each id in [0, 1): 64 bits of BLAKE2b over ``seed:id``."""

    @F.pandas_udf(DoubleType())
    def place(values: pd.Series) -> pd.Series:
        return values.map(lambda x: int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "big") / 2**64)

    return place(ids)


def canonical(text: Column, connectors: bool = False) -> Column:
    """Folded text whose words are separated by single blanks; ``connectors`` turns a lone & or + into "and"."""
    folded = fold(F.coalesce(text, F.lit("")))
    if connectors:
        folded = F.regexp_replace(folded, r"(?<![\p{L}\p{N}_])[&+](?![\p{L}\p{N}_])", " and ")
    return F.trim(F.regexp_replace(folded, _NOT_WORD, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def legal_form(full: Column) -> Column:
    """The legal-form words that end a name, in their order."""
    return F.trim(F.regexp_extract(full, rf"(?:^| )({_SUFFIX}(?: {_SUFFIX})*)$", 1))


def core_name(full: Column) -> Column:
    """The name without its legal form, unless nothing would be left."""
    bare = F.trim(F.regexp_replace(full, rf"(?:^| ){_SUFFIX}(?: {_SUFFIX})*$", ""))
    return F.when(bare == "", full).otherwise(bare)


def sorted_view(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def acronym(core: Column) -> Column:
    words = tokens(core)
    return F.when(F.size(words).between(2, 10), F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def numeric_tokens(address: Column) -> Column:
    return F.regexp_extract_all(address, F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+[a-z]?(?![\p{L}\p{N}_])"), F.lit(0))


def postcode(address: Column) -> Column:
    """The last run of 5 or 6 digits, else empty."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(address, F.lit(r"(?<!\p{Nd})(?:\p{Nd}{5}|\p{Nd}{6})(?!\p{Nd})"), F.lit(0)), F.lit(-1)), F.lit(""))


def informative(words: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` characters that aren't all digits."""
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= least) & ~t.rlike(r"^\p{Nd}+$")))


def char_ngrams(text: Column, low: int = 3, high: int = 4) -> Column:
    """Character n-grams of each word padded with a blank on both sides; a padded word no longer than n counts once and ends its series."""

    def of_word(w: Column) -> Column:
        size = F.length(w) + 2
        lengths = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (size > n - 1))
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: padded.substr(i, n))))

    return F.flatten(F.transform(tokens(text), of_word))


def token_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def length_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.least(F.length(left), F.length(right)) / longest)


def edge_ratio(left: Column, right: Column, suffix: bool = False) -> Column:
    """Length of the common prefix (suffix) over the longer length; two empty strings are equal."""
    a, b = (F.reverse(left), F.reverse(right)) if suffix else (left, right)
    shortest, longest = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    same = F.when(shortest == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (a.substr(F.lit(1), i) == b.substr(F.lit(1), i)), i).otherwise(n)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def script_mismatch(left: Column, right: Column) -> Column:
    """Whether exactly one of the two has a letter outside ASCII."""
    odd = r"[\p{L}&&[^\x00-\x7F]]"
    return left.rlike(odd) != right.rlike(odd)
