"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Base counts of the whole text (words are runs without space, tab, LF, VT, FF, CR):
word_chars, n_symbols, n_dup_lines, n_repeat_words, and a fixed floor (`base_failed`).

Verdict: four scores, each a ratio of base counts, are compared with cutoffs.  For every
stratum (language) and score, cutoffs are tested on labelled good rows from the loosest to the
strictest: the hypothesis "this cutoff rejects at least `risk / 4` of the stratum's good rows"
must be refuted by the exact binomial tail at level `error / (strata x scores)`.  Testing in a
fixed order keeps that level over the cutoffs of one score; the division (Bonferroni) covers
strata and scores.  So with probability 1 - `error` no stratum loses more than `risk` of its
good rows.  The strictest cutoff of the unbroken run is taken; where even the loosest can't be
refuted (few labels), that score rejects nothing there.  Good rows here are those that pass the
floor: what the floor rejects is fixed by the contract and outside the guarantee.

The text is read once: base counts go to a narrow table in the shared folder, and labels,
cutoffs and verdicts work on that table.

Defined results: null and empty texts have no words and fail the floor; null languages are one
stratum; very long texts are counted whole; where a doc_id has several labels it counts as good if any says so, null labels count
as none; labels of null ids are ignored; repeated rows are judged alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import materialize, small_enough, text_or_empty, tidy

SPACE = r"[\t-\r ]+"
WINDOW = 5
RISK, ERROR = 0.02, 0.05
DEVIATIONS = 12  # that many standard deviations below k a tail's terms are under 1e-31 of its first
MOST_BROADCAST_ROWS = 10_000
# Cutoffs to test, strictest first.
CUTOFFS = {
    "symbols": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 1.0),
    "dup_lines": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "repeats": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0),
}


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words and the base counts of every row; one narrow pass over the text.

    A 5-word window is its words' 64-bit hashes hashed together.  Texts whose windows are all
    different (counted by a hash set) have no repeated words; only the others sort theirs.
    """
    t = F.col("t")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("?")).alias("stratum"), text_or_empty().alias("t"))
    rows = rows.select(
        "doc_id", "stratum",
        F.transform(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\t-\r ]")).alias("lines"),
    )
    n = F.size("h")
    rows = rows.select(
        "doc_id", "stratum", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("win"),
    )
    rows = rows.withColumn("again", F.size("win") > F.size(F.array_distinct("win")))
    rows = rows.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("s")
    twice = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"])) | ((k + 1 < n) & (F.get("s", k + 1)["h"] == x["h"])))
    rows = rows.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("p", lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get("p", k + 1) - x), F.lit(WINDOW)).cast("long"))
    repeats = F.when(F.col("again"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def scores() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {"symbols": F.col("n_symbols") / chars, "dup_lines": F.col("n_dup_lines") / words, "repeats": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words}


def log_factorial(n: Column) -> Column:
    x = n.cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    large = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, small).otherwise(large)


def refuted(n: Column, k: Column, rate: float, level: float) -> Column:
    """Whether P(Binomial(n, rate) <= k) <= level.

    The tail is summed from k downwards, over as many standard deviations as doubles can tell apart
    and 64 terms more for small n; so the number of terms grows with the root of n.
    """
    at_k = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    odds = (1 - rate) / rate
    step = lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * i * odds / (n - i + 1)).alias("term"))
    terms = F.ceil(DEVIATIONS * F.sqrt(n * rate * (1 - rate))) + 64
    down = F.transform(F.sequence(F.lit(0).cast("long"), F.least(k, terms).cast("long")), lambda j: (k - j).cast("double"))
    tail = F.aggregate(down, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), step)["sum"]
    return F.when(k >= n * rate, F.lit(False)).otherwise(at_k + F.log(tail) <= math.log(level))


def thresholds(counts: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row per stratum: the cutoff of every score, null where nothing may be rejected."""
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    holdout = counts.where(~base_failed()).join(good, "doc_id").select("stratum", *[v.alias(k) for k, v in scores().items()])
    sums = [F.count("*").alias("n")] + [F.sum((F.col(s) > c).cast("long")).alias(f"{s}_{i}") for s, cs in CUTOFFS.items() for i, c in enumerate(cs)]
    by_stratum = holdout.groupBy("stratum").agg(*sums)
    tests = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(c).alias("cutoff"), F.col(f"{s}_{i}").alias("k")) for s, cs in CUTOFFS.items() for i, c in enumerate(cs)])
    strata = max(1, by_stratum.count())
    tested = by_stratum.select("stratum", "n", F.inline(tests)).withColumn("ok", refuted(F.col("n"), F.col("k"), risk / len(CUTOFFS), error / (strata * len(CUTOFFS))))
    loosest_first = Window.partitionBy("stratum", "score").orderBy(F.desc("cutoff"))  # a row per cutoff
    run = tested.withColumn("run", F.min("ok").over(loosest_first)).where("run")
    return run.groupBy("stratum").agg(*[F.min(F.when(F.col("score") == s, F.col("cutoff"))).alias(f"max_{s}") for s in CUTOFFS])


@tidy
def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Base counts, base_failed and kept of every row."""
    counts = materialize(base_counts(docs), "quality-counts")
    cutoffs = materialize(thresholds(counts, labels, risk, error), "quality-cutoffs")
    if small_enough(cutoffs, MOST_BROADCAST_ROWS):  # else an ordinary join; strata are languages, so few
        cutoffs = F.broadcast(cutoffs)
    passes = ~base_failed()
    for s, value in scores().items():
        passes = passes & F.coalesce(value <= F.col(f"max_{s}"), F.lit(True))
    return counts.join(cutoffs, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), passes.alias("kept"))


def oracle(risk: float = RISK, error: float = ERROR) -> str:
    """The same in DuckDB SQL, on strings instead of hashes and with lgamma for the tail."""
    rate = risk / len(CUTOFFS)
    value = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    grid = ", ".join(f"('{s}', {c!r}::DOUBLE)" for s, cs in CUTOFFS.items() for c in cs)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(l) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS l FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x09-\\x0D ]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
v AS (SELECT *, {", ".join(f"({e})::DOUBLE AS {s}" for s, e in value.items())} FROM f),
good AS (SELECT v.* FROM v JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) g ON g.doc_id = v.doc_id WHERE NOT base_failed),
grid(score, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, score, cutoff, count(*) AS n, count(*) FILTER (CASE score {" ".join(f"WHEN '{s}' THEN {s}" for s in CUTOFFS)} END > cutoff) AS k FROM good, grid GROUP BY ALL),
p AS (SELECT *, k < n * {rate!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r}))))
        <= {error!r} / ((SELECT count(DISTINCT stratum) FROM k) * {len(CUTOFFS)}) AS ok FROM k),
run AS (SELECT *, min(ok) OVER (PARTITION BY stratum, score ORDER BY cutoff DESC) AS run FROM p),
cut AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (score = '{s}') AS max_{s}" for s in CUTOFFS)} FROM run WHERE run GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({s} <= max_{s}, true)" for s in CUTOFFS)} AS kept
FROM v LEFT JOIN cut ON cut.stratum = v.stratum"""
