"""Keyword-stuffed and link-list pages by robust Mahalanobis distance.

Each text becomes five features: link density, list density, word entropy, repetition, and the share of its characters that stand in
sentence-like stretches (near function words). Per language, location and scatter of the features are estimated robustly over all
documents: from medians and quartiles, by concentration steps that re-estimate both from the three quarters of documents lying closest. A
text is an outlier if its distance passes a chi-square cutoff, and spam-directed if it lies on the side of more links, lists and repetition
and fewer sentences.

Function words are listed for the languages in FUNCTION_WORDS; those of any other language are learned as the words of at least LEARNED of
its documents. Every pass over the features is array code with fixed-size sums per language; only these sums are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkseek.runtime import materialize

FEATURES = ("links", "lists", "entropy", "repetition", "sentences")
#: Which way spam lies in each feature.
TOWARDS = {"links": 1.0, "lists": 1.0, "entropy": -1.0, "repetition": 1.0, "sentences": -1.0}
#: Chi-square quantiles for five features: median, 99.9 % (fixed values).
CHI2_MEDIAN, CHI2_CUTOFF = 4.351, 20.515
KEPT = 0.75
STEPS = 3
#: Smallest spread of a feature: below it a difference says nothing.
FLOOR = 0.03
LEAST_DOCUMENTS = 60
MAX_LANGUAGES = 1000
REACH = 4

#: Function words (fixed values), without those that also join the nouns of product names and search phrases.
FUNCTION_WORDS = {
    "en": """the a an is was are were it i my we this that than with what had has have for but so and to of in on at be been not they you your its it's would me if after
    since because from as do does did before when which who i'd don't isn't there them their he she our no by or just really about could can will""",
    "de": """der die das ist war ich es und nicht mit ein eine einen einer den dem auf für zu zum im wie sich als aber hat habe haben hatte wir sie mein meine meinen nach
    vor von bei aus noch auch dass weil wenn nur sehr schon sind wird wurde er ihn ihr was""",
    "es": """el la los las es era un una y que no con lo me mi se por su muy pero como al del más ya fue ha he está son sin le cuando porque tiene antes nos en después otro otra otros otras""",
    "fr": """le les est était une et ne ce je il elle on nous pour dans mon ma son sur au mais comme sont été ai très qui c'est j'ai n'est avec avait cette ça des""",
}
#: Share of a language's documents that a learned function word stands in, and the most words learned of a language.
LEARNED, MAX_LEARNED = 0.25, 200
CACHED_TOKENS = 200_000
#: Of these, the ones that join search phrases of another language (fixed values): they count only in texts of their own.
JOINING = {"es": "en"}
_BITS = {language: 1 << i for i, language in enumerate(FUNCTION_WORDS)}
_ANY = 1 << len(_BITS)  # counts in a text of any language
_KINDS: dict[str, int] = {}
for _language_name, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _KINDS[_word] = _KINDS.get(_word, 0) | _BITS[_language_name] | (0 if _word in JOINING.get(_language_name, "").split() else _ANY)
_ELIDED = regex.compile(r"(?:[jlnmcst]|qu)'\w")
_JAPANESE = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_PARTICLE = regex.compile("は|を|に|が|で[すし]|ます|まし|した|ない|って|から|より")
_RUN = regex.compile(r"[、。，．,.!?！？]+")
_SPLIT = re.compile(r"[\n\r|•·;]+|\s/\s|\s[-–—]\s|\s\*\s|->")
_STRIP = regex.compile(r"^[^\w']+|[^\w']+$")
_BARE = r"[^\p{L}\p{N}']+"
_ENDS = "test|example|invalid|com|net|org|info|biz|shop|store|online|site|io|co|de|es|fr|jp|uk|us|ru|cn"
_LINK = regex.compile(
    rf"""<li>|</li>|<a\s[^>]{{0,2000}}>[^<]{{0,400}}</a>|\[url=[^\]\s]{{0,2000}}\][^\[]{{0,400}}\[/url\]|\[[^\]\n]{{0,400}}\]\([^)\s]{{1,2000}}\)|(?:https?|hxxps?|ftp)://\S+
    |(?<![\w.@-])(?:[\w-]{{1,80}}(?:\.|\[\.\]|\(\.\)|\ dot\ |\[dot\]|\(dot\))){{1,8}}(?:{_ENDS})(?![\w-])(?:[/?\#]\S*)?""",
    regex.IGNORECASE | regex.VERBOSE,
)
#: What every match of _LINK has: looked for first.
_HINT = re.compile(r"://|[<\[]|\(\.\)|\.[a-z]| dot ", re.IGNORECASE)


#: Characters of the Western code page by the byte they stand for, as they appear where UTF-8 was read in it.
_BYTE = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_MISREAD = regex.compile("[" + "".join(map(regex.escape, _BYTE)) + "]{2,}")


#: A first byte of a UTF-8 sequence before a later one, both read as characters.
_LEAD = re.compile("[{}][{}]".format(*("".join(re.escape(c) for c, b in _BYTE.items() if low <= b < high) for low, high in ((0xC2, 0xF5), (0x80, 0xC0)))))


def _repaired(text: str) -> str:
    """The text with UTF-8 sequences that were read as single-byte characters put right; anything else stays."""

    def back(m: regex.Match) -> str:
        try:
            return bytes(_BYTE[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return text if text.isascii() or not _LEAD.search(text) else _MISREAD.sub(back, text)


PLAIN, TAG = 0, None


class Extractor:
    """Features of texts; keeps what it knows of tokens. ``learned``: function words beside the listed ones.

    A word that joins search phrases of another language counts only in texts of its own: where that language has the most different
    function words, such words apart.
    """

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.learned = learned
        self.tokens: dict[str, tuple[int | None, str]] = {}

    def token(self, token: str) -> tuple[int | None, str]:
        """(languages in which it is a function word as bits, or TAG; bare word)."""
        word = _STRIP.sub("", token.lower())
        plain = word.replace("’", "'")
        if token.startswith("#"):
            kind = TAG
        elif plain in self.learned or _ELIDED.match(plain) or (_JAPANESE.search(token) and any(_PARTICLE.search(run) for run in _RUN.split(token))):
            kind = _ANY
        else:
            kind = _KINDS.get(plain, PLAIN)
        if len(token) <= 64:
            if len(self.tokens) >= CACHED_TOKENS:
                self.tokens.clear()
            self.tokens[token] = kind, word
        return kind, word

    @staticmethod
    def languages(words: set[tuple[int, str]]) -> int:
        """The bit of the language with the most of the words, 0 in a tie."""
        hits = [sum(1 for kind, _ in words if kind & _ANY and kind & bit) for bit in _BITS.values()]
        most = max(hits)
        return list(_BITS.values())[hits.index(most)] if hits.count(most) == 1 else 0

    def features(self, text: str | None) -> tuple[float, float, float, float, float]:
        """The five features of a text; one without words counts as neutral. Time and memory are linear in its length."""
        if not text or text.isspace():
            return 0.0, 0.0, 1.0, 0.0, 1.0
        text = _repaired(text)
        link = tags = spoken = plain = 0
        gaps = [text]
        if _HINT.search(text):
            gaps, at = [], 0
            for m in _LINK.finditer(text):
                gaps.append(text[at : m.start()])
                link += sum(map(len, m.group().split()))
                at = m.end()
            gaps.append(text[at:])
        separators = sum(gap.count(c) for gap in gaps for c in ",|;#:/•·")
        known, learn = self.tokens.get, self.token
        stretches = [[(len(t), *(known(t) or learn(t))) for t in stretch.split()] for gap in gaps for stretch in _SPLIT.split(gap)]
        bare = [word for tokens in stretches for _, _, word in tokens]
        spoken_here = _ANY
        if any(kind and not kind & _ANY for tokens in stretches for _, kind, _ in tokens):
            spoken_here |= self.languages({(kind, word) for tokens in stretches for _, kind, word in tokens if kind})
        for tokens in stretches:
            since, waiting = REACH + 1, []  # sizes of the tokens that no function word is near so far
            for size, kind, _ in tokens:
                if kind and kind & spoken_here:
                    spoken += size
                    if waiting:
                        spoken += sum(waiting[-REACH:])
                        plain += sum(waiting[:-REACH])
                        waiting = []
                    since = 0
                    continue
                since += 1
                if kind is TAG:
                    tags += size
                    size = 0
                if since <= REACH:
                    spoken += size
                else:
                    waiting.append(size)
            plain += sum(waiting)
        chars, count = link + tags + spoken + plain, len(bare)
        if not chars:
            return 0.0, 0.0, 1.0, 0.0, 1.0
        words = Counter(bare)
        entropy = (log(count) - sum(n * log(n) for n in words.values() if n > 1) / count) / log(count) if count > 1 else 1.0
        repetition = 1 - len(words) / count if count else 0.0
        return link / chars, min(separators / max(count, 1), 2.0) + tags / chars, entropy, repetition, spoken / chars


def features(text: str | None) -> tuple[float, float, float, float, float]:
    """The five features of one text, by the listed function words."""
    return Extractor().features(text)


def _extract(learned: frozenset[str]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Extractor(learned)
        for batch in batches:
            rows = [e.features(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))], list(FEATURES))

    return arrow_udf(run, ", ".join(f"{f} double" for f in FEATURES))


def _language(lang_col: str):
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang_col), F.lit("")))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code == "", "other").otherwise(code)


def learned_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> frozenset[str]:
    """Function words of the languages that FUNCTION_WORDS lacks and that have LEAST_DOCUMENTS: words of at least LEARNED of their documents.

    Japanese, whose particles aren't words between blanks, and texts without a language are left to the listed words. What reaches the driver is at
    most MAX_LEARNED words a language.
    """
    texts = docs.select(_language(lang_col).alias("language"), F.col(text_col).alias("text")).where(~F.col("language").isin("other", "ja", *FUNCTION_WORDS) & F.col("text").isNotNull())
    sizes = texts.groupBy("language").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).limit(MAX_LANGUAGES).collect()
    if not sizes:
        return frozenset()
    n = F.create_map(*(F.lit(x) for r in sizes for x in (r["language"], r["n"])))
    words = texts.select("language", F.explode(F.array_distinct(F.split(F.lower("text"), _BARE))).alias("word")).where("word <> ''")
    common = words.groupBy("language", "word").agg(F.count("*").alias("c")).where(F.col("c") >= LEARNED * F.try_element_at(n, F.col("language")))
    best = common.groupBy("language").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "word"))), 1, MAX_LEARNED).alias("best"))  # a language has few words in a quarter of its documents
    return frozenset(w["word"] for r in best.collect() for w in r["best"])


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, length, features...). Languages by their first subtag in lower case; null and odd ones are ``other``."""
    extract = _extract(learned_words(docs, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), _language(lang_col).alias("language"), F.coalesce(F.length(text_col), F.lit(0)).alias("length"), extract(F.col(text_col)).alias("f"))
    return rows.select("doc_id", "language", "length", "f.*")


#: Bins of a feature's histogram over 0 to 3, and of the logarithm of the squared distance.
FEATURE_BINS, DISTANCE_BINS, BINS_PER_OCTAVE = 768, 160, 8
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_SUMS = 1 + len(FEATURES) + len(_PAIRS)


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, its row numbers, their features) of a batch of (language, features...)."""
    x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1)
    coded = batch.column(0).dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    for i, language in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(at == i)
        yield language, rows, x[rows]


def _squared(x: np.ndarray, center: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    z = x - center
    return np.einsum("ij,jk,ik->i", z, inverse, z)


def _distance_bin(square: np.ndarray) -> np.ndarray:
    return np.clip(BINS_PER_OCTAVE * np.log2(1 + np.maximum(square, 0)), 0, DISTANCE_BINS - 1).astype(int)


def _tables(rows: DataFrame, size: int, count) -> dict[str, np.ndarray]:
    """language -> sums of ``count(language, features)`` (a table of ``size`` numbers) over all rows; ``*`` has those of all languages.

    A task adds up its rows first; what reaches the driver is one table per language (at most MAX_LANGUAGES).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, _, x in _grouped(batch):
                sums[language] = sums.get(language, 0) + count(language, x)
        for language, table in sums.items():
            slot = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(table[slot])], ["language", "slot", "value"])

    cells = rows.select("language", *FEATURES).mapInArrow(run, "language string, slot int, value double").groupBy("language", "slot").agg(F.sum("value").alias("value"))
    found = cells.limit((MAX_LANGUAGES + 1) * size).toPandas()
    out: dict[str, np.ndarray] = {"*": np.zeros(size)}
    for language, part in found.groupby("language"):
        out[language] = np.zeros(size)
        out[language][part["slot"].to_numpy()] = part["value"].to_numpy()
        out["*"] += out[language]
    if len(out) > MAX_LANGUAGES + 1:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return out


def _quantile(histogram: np.ndarray, share: float) -> int:
    """The first bin up to which ``share`` of the histogram lies."""
    upto = histogram.cumsum()
    return int(np.searchsorted(upto, share * upto[-1] - 1e-9))


class RobustScatter:
    """Robust location and scatter per language from all rows; ``*`` pools them, and stands in for languages with few documents.

    A step is one pass of fixed-size sums: features' sums by bins of the squared distance, of which the nearest KEPT make the next figures.
    """

    def __init__(self, rows: DataFrame, steps: int = STEPS):
        self.center: dict[str, np.ndarray] = {"*": np.zeros(len(FEATURES))}
        self.inverse: dict[str, np.ndarray] = {"*": np.eye(len(FEATURES)) / FLOOR**2}

        def histograms(_, x: np.ndarray) -> np.ndarray:
            bins = np.clip(x * (FEATURE_BINS / 3), 0, FEATURE_BINS - 1).astype(int) + FEATURE_BINS * np.arange(len(FEATURES))
            return np.bincount(bins.ravel(), minlength=FEATURE_BINS * len(FEATURES)).astype(float)

        for language, table in _tables(rows, FEATURE_BINS * len(FEATURES), histograms).items():
            each = table.reshape(len(FEATURES), FEATURE_BINS)
            if each[0].sum() and (language == "*" or each[0].sum() >= LEAST_DOCUMENTS):
                quarters = np.array([[_quantile(h, q) for q in (0.25, 0.5, 0.75)] for h in each]) * (3 / FEATURE_BINS)
                self.center[language] = quarters[:, 1]
                self.inverse[language] = np.diag(1 / np.maximum((quarters[:, 2] - quarters[:, 0]) / 1.349, FLOOR) ** 2)
        for _ in range(steps):
            for language, table in _tables(rows, DISTANCE_BINS * _SUMS, self._sums()).items():
                bins = table.reshape(DISTANCE_BINS, _SUMS)
                if language not in self.center or not bins[:, 0].any():
                    continue
                total = bins[: _quantile(bins[:, 0], KEPT) + 1].sum(0)
                mean = total[1 : 1 + len(FEATURES)] / total[0]
                cov = np.zeros((len(FEATURES),) * 2)
                for (i, j), p in zip(_PAIRS, total[1 + len(FEATURES) :]):
                    cov[i, j] = cov[j, i] = p / total[0] - mean[i] * mean[j]
                self.center[language], self.inverse[language] = mean, np.linalg.inv(cov + FLOOR**2 * np.eye(len(FEATURES)))
        for language, table in _tables(rows, DISTANCE_BINS * _SUMS, self._sums()).items():
            counts = table.reshape(DISTANCE_BINS, _SUMS)[:, 0]
            if language in self.center and counts.any():  # the kept rows spread less than all do; never shrink distances below the floor's scale
                median = 2 ** ((_quantile(counts, 0.5) + 0.5) / BINS_PER_OCTAVE) - 1
                self.inverse[language] = self.inverse[language] * min(CHI2_MEDIAN / median, 1.0)

    def of(self, language: str) -> tuple[np.ndarray, np.ndarray]:
        name = language if language in self.center else "*"
        return self.center[name], self.inverse[name]

    def _sums(self):
        of = dict(self.center), dict(self.inverse)

        def count(language: str, x: np.ndarray) -> np.ndarray:
            name = language if language in of[0] else "*"
            at = _distance_bin(_squared(x, of[0][name], of[1][name]))
            values = np.concatenate((np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in _PAIRS], 1)), 1)
            return np.stack([np.bincount(at, values[:, c], DISTANCE_BINS) for c in range(_SUMS)], 1).ravel()

        return count

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``distance2`` and ``direction``: the standardized deviation towards spam."""
        towards = np.array([TOWARDS[f] for f in FEATURES])
        known = dict(self.center), dict(self.inverse)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                square, direction = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for language, at, x in _grouped(batch.select(["language", *FEATURES])):
                    name = language if language in known[0] else "*"
                    square[at] = _squared(x, known[0][name], known[1][name])
                    direction[at] = (x - known[0][name]) @ towards
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(square), pa.array(direction)], [*batch.schema.names, "distance2", "direction"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{schema}, distance2 double, direction double")


def spam_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, language, length, features..., distance2, direction, outlier) of all documents."""
    rows = materialize(with_features(docs), "features")
    scored = RobustScatter(rows).score(rows)
    return scored.withColumn("outlier", (F.col("distance2") > CHI2_CUTOFF) & (F.col("direction") > 0))


def stuffed(docs: DataFrame, least_length: int = 60) -> DataFrame:
    """(doc_id) of stuffed texts: spam-directed outliers of at least ``least_length`` characters; then the exact check that less than half of the characters stand in sentences."""
    return spam_scores(docs).where("outlier").where((F.col("length") >= least_length) & (F.col("sentences") < 0.5)).select("doc_id")
