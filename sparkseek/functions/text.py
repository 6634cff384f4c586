"""N-gram and word tokenizing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEPT = re.compile("[^a-z0-9]+")


def kept_characters(text: Column) -> Column:
    """ASCII mode: letters and digits in lower case, and blanks."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9 \t\n\r]", ""))


def ngrams(text: Column, n: int, normalize: str = "ascii") -> Column:
    """Array of the n-grams of each word with at least n characters; null text gives null, empty text an empty array.

    One overlapping match over the whole text: grams have no blanks, so none crosses words. Linear in the length of the text.
    """
    clean = nfkd_ascii(text) if normalize == "nfkd" else text
    return F.regexp_extract_all(kept_characters(clean), F.lit(f"(?=([a-z0-9]{{{n}}}))"), F.lit(1))


def ngrams_between(text: Column, low: int, high: int, normalize: str = "ascii") -> Column:
    """All n-grams with low <= n <= high, shorter first."""
    clean = nfkd_ascii(text) if normalize == "nfkd" else text
    return F.flatten(F.array(*(ngrams(clean, n) for n in range(low, high + 1))))


def gram_positions(phrase: str, n: int) -> list[tuple[str, int, int]]:
    """(gram, offset, span) of a phrase, NFKD mode; offset and span count characters of the original text."""
    kept: list[tuple[str, int]] = []
    groups: list[list[tuple[str, int]]] = [kept]
    for at, char in enumerate(phrase):
        for part in unicodedata.normalize("NFKD", char):
            if part.isascii() and part.isalnum():
                groups[-1].append((part.lower(), at))
            elif part.isascii() and part.isspace():
                groups.append([])
    return [("".join(c for c, _ in g[i : i + n]), g[i][1], g[i + n - 1][1] - g[i][1] + 1) for g in groups for i in range(len(g) - n + 1)]


def normal_form(word: str) -> str:
    """NFKD, only ASCII letters and digits kept, lower case."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    return _KEPT.sub("", "".join(c for c in word if c < "\x80").lower())


def _per_distinct(values: pa.Array, fn) -> pa.Array:
    coded = values.dictionary_encode()
    done = pa.array([None if w is None else fn(w) for w in coded.dictionary.to_pylist()], pa.string())
    return done.take(coded.indices)


def _normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield _per_distinct(values, normal_form)


def _ascii(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield _per_distinct(values, lambda s: s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if c < "\x80"))


def normalized(word: Column) -> Column:
    """Normal form of a column of words. Null stays null. ASCII words stay in the JVM; of others each distinct spelling of a batch is converted once."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(F.regexp_replace(word, "[^A-Za-z0-9]+", ""))).otherwise(_arrow(_normalize)(F.when(~plain, word)))


def nfkd_ascii(text: Column) -> Column:
    """NFKD, then ASCII characters only."""
    return _arrow(_ascii)(text)


def _arrow(fn):
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(fn, "string")
