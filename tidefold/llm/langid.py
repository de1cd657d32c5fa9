"""Language identification by Bayesian evidence fusion.

log P(lang | everything) = weight * log P(text | lang)      n-gram naive Bayes, whole text
                         + log P(declared | lang)           the declared markup language
                         + log P(address suffix | lang)     country suffixes of the host
                         + log P(lang | host) + const       hierarchically smoothed prior

The prior of a host is a Dirichlet mean that backs off from host to registered domain (where
the host is not its own) to the whole corpus; its counts of declared languages come from one grouped aggregation over all rows,
and a row's own declaration is taken out of them again before they speak about that row.  The
text model is fitted from the `sample` rows with the smallest hash of their key and, for a
language that has fewer than LEAST_ROWS rows among them, from its own LEAST_ROWS smallest.  How often
a declaration is right is read off the same rows, each against the counts of the others.  Every
declared value is a language; the driver holds a count and a sparse column for each.  The rates
are interpolated with those of all languages together, so an n-gram that no language has seen
speaks for none.

One more hypothesis stands beside the languages: that the text is in none of them.  What a text
of a language is like is read off the fitted rows themselves, each against the counts of the
others: the mean log rate of its trigrams of letters, and how far it varies for a text of that
length.  A text that lies z deviations below is 1 : exp((z^2 - OUTLIER^2) / 2) likelier in none
of them than in the best language, whatever its declaration and host say.  Texts of fewer than
LEAST_TRIGRAMS such trigrams stay with the declared languages.

A row is kept unless the evidence leaves its language open: its text has no letters, or the
best posterior is under `least`, or the language isn't one of `wanted` (None: any).

Defined results: null text is empty, null or unknown declarations and hosts say nothing; ties go
to the language first in alphabetical order; repeated rows get equal results; without any
declared language every row is rejected with lang null; very long texts are read whole; other
columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import hash_sample, map_arrow, materialize, release, row_slices, small_enough, tidy
from tidefold.llm.ngrams import code_points, hashed

BITS = 17
LENGTHS = (1, 2, 3)
SAMPLE = 3000
LEAST_ROWS = 20
DENSE = 64  # languages; the model of more is sparse
SHARED = 0.1  # of every rate comes from all languages together
OUTLIER = 6.0
LEAST_SPREAD = 0.15
LEAST_TRIGRAMS = 8  # shorter texts can't tell that they are in no declared language
OVERLAP = 3  # neighbouring trigrams share letters: a text of n counts as n / 3 independent ones
MOST_HOSTS = 100_000
# Country suffixes that point to one language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


class Sparse:
    """A matrix of buckets x languages that is mostly 0."""

    def __init__(self, columns: list[tuple[np.ndarray, np.ndarray]]):
        """`columns`: per language its buckets and their values."""
        self.k = len(columns)
        keys = np.concatenate([bucket * self.k + j for j, (bucket, _) in enumerate(columns)])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.concatenate([value for _, value in columns]).astype(np.float32)[order]
        self.start = np.searchsorted(self.keys, np.arange((1 << BITS) + 1) * self.k)

    def sum(self, found: np.ndarray) -> np.ndarray:
        bucket, n = np.unique(found, return_counts=True)
        size = self.start[bucket + 1] - self.start[bucket]
        at = np.repeat(self.start[bucket] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.keys[at] % self.k, self.values[at].astype(np.float64) * np.repeat(n, size), self.k)

    def column(self, found: np.ndarray, j: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, found * self.k + j), len(self.keys) - 1)
        return np.where(self.keys[at] == found * self.k + j, self.values[at], 0)


@dataclass
class Model:
    languages: list[str]
    log_rate: np.ndarray | Sparse  # buckets x languages, against what all languages share
    declared_right: float = 0.9
    suffix_right: float = 0.8
    text_weight: float = 0.25
    strength: float = 20.0
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_shared: np.ndarray | None = None  # per bucket; without it no text is foreign
    usual: np.ndarray | None = None  # languages x (mean log rate, its variance, variance of one trigram)

    def __post_init__(self):
        self.place = {lang: j for j, lang in enumerate(self.languages)}

    def spread(self, counts: list[tuple[str, int]] | None) -> np.ndarray | None:
        """Counts by name as one number for each language."""
        if counts is None:
            return None
        out = np.zeros(len(self.languages))
        for lang, n in counts:
            out[self.place[lang]] = n
        return out

    def text_evidence(self, text: str) -> tuple[np.ndarray, bool]:
        points = code_points(text)
        found = hashed(points, LENGTHS, BITS)
        rates = self.log_rate.sum(found) if isinstance(self.log_rate, Sparse) else self.log_rate[found].sum(axis=0, dtype=np.float64)
        return self.text_weight * rates, bool(_letter(text))

    def foreign(self, text: str, language: int) -> float:
        """log of how much likelier the text is in none of the languages than in this one."""
        if self.usual is None or self.log_shared is None:
            return -np.inf
        found = letter_trigrams(text)
        if len(found) < LEAST_TRIGRAMS:
            return -np.inf
        mean, between, within = self.usual[language]
        own = self.log_rate.column(found, language) if isinstance(self.log_rate, Sparse) else self.log_rate[found, language]
        rate = float((own + self.log_shared[found]).mean())
        z = max(0.0, mean - rate) / np.sqrt(between + within * OVERLAP / len(found))
        return float(min((z * z - OUTLIER * OUTLIER) / 2, 700.0))

    def claim(self, said: str | None, right: float) -> np.ndarray:
        """log P(claim | language), flat if the claim names none of the languages."""
        k = len(self.languages)
        if said not in self.place or k < 2:
            return np.zeros(k)
        out = np.full(k, np.log((1 - right) / (k - 1)))
        out[self.place[said]] = np.log(right)
        return out

    def prior(self, host: list[int] | None, domain: list[int] | None, declared: str | None) -> np.ndarray:
        own = np.zeros(len(self.languages))
        if declared in self.place:
            own[self.place[declared]] = 1
        mean = np.full(len(self.languages), 1 / len(self.languages))
        for counts in (self.totals, domain, host):
            if counts is not None:
                counts = np.maximum(np.asarray(counts, dtype=np.float64) - own, 0)
                mean = (counts + self.strength * mean) / (counts.sum() + self.strength)
        return np.log(np.maximum(mean, 1e-9))


_letter = re.compile(r"[^\W\d_]").search


def letter_trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams made of letters and spaces only; numbers, codes and marks tell no language."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    letter = np.strings.isalpha(np.ascontiguousarray(points, dtype="<u4").view("<U1")) | ((points >= 0x300) & (points < 0x2000))
    letter = np.concatenate(([False], letter, [False]))
    plain = letter | np.concatenate(([True], points == 32, [True]))
    found = hashed(points, (3,), BITS)
    return found[plain[:-2] & plain[1:-1] & plain[2:] & (letter[:-2] | letter[1:-1] | letter[2:])]


@functools.lru_cache(maxsize=4096)
def suffix_language(host: str | None) -> str | None:
    return SUFFIX_LANGUAGE.get(host.rsplit(".", 1)[-1]) if host and "." in host else None


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams and how often each occurs."""
    return np.unique(hashed(code_points(text), LENGTHS, BITS), return_counts=True)


@dataclass
class Counts:
    """What the fitted rows hold: of each language its n-grams and their counts."""

    languages: list[str]
    found: list[tuple[np.ndarray, np.ndarray]]

    def __post_init__(self):
        self.of_all = np.zeros(1 << BITS)
        for bucket, n in self.found:
            self.of_all[bucket] += n
        self.total = self.of_all.sum()
        self.shared = SHARED * pooled(self.of_all, self.total)

    def model(self, totals: list[int]) -> Model:
        columns = [(bucket, np.log1p((1 - SHARED) * n / max(n.sum(), 1) / self.shared[bucket])) for bucket, n in self.found]
        if len(self.languages) > DENSE:
            log_rate: np.ndarray | Sparse = Sparse(columns)
        else:
            log_rate = np.zeros((1 << BITS, len(self.languages)), dtype=np.float32)
            for j, (bucket, value) in enumerate(columns):
                log_rate[bucket, j] = value
        return Model(self.languages, log_rate, totals=np.asarray(totals, dtype=np.float64), log_shared=np.log(self.shared).astype(np.float32))

    def without(self, j: int, own: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The rates of a row's n-grams in its language, against the counts of all other rows."""
        bucket, counts = self.found[j]
        at = np.minimum(np.searchsorted(bucket, own), max(len(bucket) - 1, 0))
        there = np.where(bucket[at] == own, counts[at], 0) if len(bucket) else np.zeros(len(own))
        return (1 - SHARED) * (there - n) / max(counts.sum() - n.sum(), 1)

    def facts(self, model: Model, text: str, language: str) -> tuple[float | None, float | None, bool | None]:
        """Of a fitted row, judged by the others: mean and variance of its trigrams' log rates, and whether its text speaks for its language."""
        j = model.place[language]
        own, n = counts_of(text)
        rate = self.without(j, own, n)
        mean = variance = agrees = None
        trigrams = letter_trigrams(text)
        if len(trigrams):
            log = np.log(rate + SHARED * pooled(self.of_all[own] - n, self.total - n.sum()))[np.searchsorted(own, trigrams)]
            mean, variance = float(log.mean()), float(log.var())
        if _letter(text):
            evidence = model.text_evidence(text)[0]
            evidence[j] = model.text_weight * (np.log1p(rate / self.shared[own]) * n).sum()
            agrees = int(evidence.argmax()) == j
        return mean, variance, agrees


def finished(model: Model, facts: list[tuple[str, float | None, float | None, bool | None]]) -> Model:
    """The model with what is usual for a text of each language, and how far declarations can be trusted."""
    model.usual = np.tile([-np.inf, 1.0, 1.0], (len(model.languages), 1))  # a language without rows to go by takes any text
    rows: dict[str, list[tuple[float, float]]] = {}
    for language, mean, variance, _ in facts:
        if mean is not None:
            rows.setdefault(language, []).append((mean, variance))
    for language, some in rows.items():
        means, variances = np.array(sorted(some)).T
        mean = np.median(means)
        spread = max(1.4826 * np.median(np.abs(means - mean)), LEAST_SPREAD)
        model.usual[model.place[language]] = mean, spread**2 * (1 + 10 / len(some)), variances.mean()
    agrees = [a for *_, a in facts if a is not None]
    if agrees:
        model.declared_right = float(np.clip(np.mean(agrees), 0.6, 0.99))
    return model


def pooled(count, total):
    """The rate of an n-gram in all languages together."""
    return (count + 0.5) / (total + 0.5 * (1 << BITS))


def fit(texts: list[str], declared: list[str], languages: list[str], totals: list[int]) -> Model:
    """Naive Bayes over hashed n-grams, from texts at hand."""
    of: dict[str, np.ndarray] = {lang: np.zeros(1 << BITS) for lang in languages}
    rows = [(t, d) for t, d in zip(texts, declared, strict=True) if d in of]
    for text, lang in rows:
        own, n = counts_of(text)
        of[lang][own] += n
    counts = Counts(languages, [(np.flatnonzero(of[x]), of[x][np.flatnonzero(of[x])]) for x in languages])
    model = counts.model(totals)
    return finished(model, [(lang, *counts.facts(model, text, lang)) for text, lang in rows])


def fit_rows(rows: DataFrame, languages: list[str], totals: list[int]) -> Model:
    """The same from a table (l, t).  Texts stay with the executors: the driver gets counts by language and n-gram, and three numbers of each row."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = materialize(rows.repartition(n), "declared-rows")

    def count(batches):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}

        def put():
            for lang, of in held.items():
                at = np.flatnonzero(of)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(of[at], pa.int64())], names=["l", "bucket", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                own, k = counts_of(text)
                if lang not in held:
                    if len(held) >= DENSE:  # of very many languages a task holds some at a time
                        yield from put()
                    held[lang] = np.zeros(1 << BITS, dtype=np.int64)
                held[lang][own] += k
        yield from put()

    table = map_arrow(rows, count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow().sort_by([("l", "ascending"), ("bucket", "ascending")])
    bucket, k = table.column("bucket").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    ends, at = {}, 0
    for entry in table.column("l").value_counts().to_pylist():
        ends[entry["values"]], at = (at, at + entry["counts"]), at + entry["counts"]
    found = [slice(*ends.get(lang, (0, 0))) for lang in languages]
    counts = Counts(languages, [(bucket[x], k[x]) for x in found])
    model = counts.model(totals)
    shared = rows.sparkSession.sparkContext.broadcast((model, counts))

    def facts(batches):
        import pyarrow as pa

        for batch in batches:
            of = batch.column("l").to_pylist()
            found = [shared.value[1].facts(shared.value[0], text, lang) for text, lang in zip(batch.column("t").to_pylist(), of, strict=True)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), *[pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.bool_()), strict=True)]], names=["l", "mean", "variance", "agrees"])

    found = map_arrow(rows, facts, "l string, mean double, variance double, agrees boolean").toArrow()
    release(rows)
    return finished(model, list(zip(*[found.column(c).to_pylist() for c in ("l", "mean", "variance", "agrees")], strict=True)))


def registered_domain(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(host)


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for `identify`: text without markup, the html tag's lang as declared, the url's host."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))


def with_priors(rows: DataFrame, key: str, declared: str, host: str, sample: int = SAMPLE, text: str = "text") -> tuple[DataFrame, Model]:
    """`rows` with the counts by language of each row's host and domain (_host, _domain), and the fitted model."""
    said, at = F.lower(F.col(declared)), F.lower(F.col(host))
    light = rows.select(said.alias("l"), at.alias("h")).where(F.col("l").isNotNull() & (F.col("l") != ""))
    pairs = light.groupBy("h", "l").count()
    by = {r.l: r.n for r in pairs.groupBy("l").agg(F.sum("count").alias("n")).collect()}
    languages = sorted(by)
    counts = F.map_from_entries(F.collect_list(F.struct("l", "count")))
    at_host = pairs.where(F.col("h").isNotNull())
    hosts = at_host.groupBy(F.col("h").alias("_h")).agg(counts.alias("_host"))
    domains = at_host.groupBy(registered_domain(F.col("h")).alias("_d"), "l").agg(F.sum("count").alias("count")).groupBy("_d").agg(counts.alias("_domain"))
    # one row per host: joined by broadcast while they are few, by shuffle beyond that
    few = F.broadcast if small_enough(hosts, MOST_HOSTS) else (lambda x: x)
    out = rows.withColumns({"_h": at, "_d": F.nullif(registered_domain(at), at)}).join(few(hosts), "_h", "left").join(few(domains), "_d", "left").drop("_h", "_d")
    picked = rows.select(F.col(key).alias("k"), said.alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.col("l").isNotNull() & (F.col("l") != ""))
    drawn = materialize(hash_sample(picked, "k", sample), "language-sample")
    of = {r.l: r["count"] for r in drawn.groupBy("l").count().collect()}
    short = [lang for lang in languages if of.get(lang, 0) < min(by[lang], LEAST_ROWS)]
    fitted = drawn.select("l", "t")
    if short:
        names = rows.sparkSession.createDataFrame([(lang,) for lang in short], "l string")
        order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "t")
        more = picked.join(F.broadcast(names), "l").withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEAST_ROWS).select("l", "t")
        fitted = fitted.join(F.broadcast(names), "l", "left_anti").unionByName(more)
    model = fit_rows(fitted, languages, [by[lang] for lang in languages])
    release(drawn)
    return out, model


def judge(model: Model, text: str | None, declared: str | None, host: str | None, of_host, of_domain, least: float, wanted: tuple[str, ...] | None):
    """(lang, language by text alone, posterior, kept)."""
    if not model.languages:
        return None, None, 0.0, False
    declared, host = declared.lower() if declared else None, host.lower() if host else None
    by_text, letters = model.text_evidence(text or "")
    log = by_text + model.claim(declared, model.declared_right) + model.claim(suffix_language(host), model.suffix_right) + model.prior(of_host, of_domain, declared)
    p = np.exp(log - log.max())
    best = int(p.argmax())
    sure = float(p[best] / (p.sum() + p[best] * np.exp(model.foreign(text or "", best))))
    lang = model.languages[best]
    return lang, model.languages[int(by_text.argmax())] if letters else None, sure, letters and sure >= least and (wanted is None or lang in wanted)


@tidy
def identify(rows: DataFrame, key: str, declared: str, host: str, least: float = 0.5, wanted: tuple[str, ...] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row: the key, lang, text_lang, confidence, kept."""
    joined, model = with_priors(rows.select(F.col(key).cast("long").alias("key"), "text", F.col(declared).alias("declared"), F.col(host).alias("host")), "key", "declared", "host", sample)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in row_slices(whole):
                columns = [batch.column(c).to_pylist() for c in ("text", "declared", "host", "_host", "_domain")]
                columns[3:] = [[shared.value.spread(c) for c in column] for column in columns[3:]]
                found = [judge(shared.value, *row, least, wanted) for row in zip(*columns, strict=True)]
                lang, text_lang, sure, kept = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(text_lang, pa.string()), pa.array(sure, pa.float64()), pa.array(kept, pa.bool_())], names=["key", "lang", "text_lang", "confidence", "kept"])

    out = map_arrow(joined.select("key", "text", "declared", "host", "_host", "_domain"), run, "key long, lang string, text_lang string, confidence double, kept boolean")
    return out.withColumnRenamed("key", key)


@tidy
def keep_identified(docs: DataFrame, key: str = "doc_id", declared: str = "lang", host: str = "source", least: float = 0.5, wanted: tuple[str, ...] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, unchanged, whose language is identified."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    key, text, declared, host = (f"c{names.index(c)}" for c in (key, "text", declared, host))
    joined, model = with_priors(numbered, key, declared, host, sample, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in row_slices(whole, column=text):
                columns = [batch.column(c).to_pylist() for c in (text, declared, host, "_host", "_domain")]
                columns[3:] = [[shared.value.spread(c) for c in column] for column in columns[3:]]
                kept = [judge(shared.value, *row, least, wanted)[3] for row in zip(*columns, strict=True)]
                yield batch.filter(pa.array(kept, pa.bool_())).select(numbered_columns).rename_columns(names)

    numbered_columns = list(range(len(names)))
    return map_arrow(joined.select(*numbered.columns, "_host", "_domain"), run, docs.schema)
