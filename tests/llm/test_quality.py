"""op4: base counts against plain Python, the binomial test against exact sums, the guarantee on drawn labels."""

import math
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tidefold.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words int, stratum string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def texts():
    rng = random.Random(1)
    odd = [None, "", "  \n\t ", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", "x y z\x85 \x1c 日本 🤗#*", "same\nsame\n\nsame \nother", "\n".join(["l | m"] * 9), "a b c d e f " * 3000]
    return odd + [" ".join(rng.choice("abcde") + rng.choice("ab#\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]


def test_base_counts(spark):
    frame = spark.createDataFrame([(i, t, None, 7, "s") for i, t in enumerate(texts())], SCHEMA)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_counts(frame).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts())}


@pytest.mark.parametrize(("n", "k", "rate"), [(0, 0, 0.05), (10, 0, 0.05), (100, 1, 0.05), (459, 0, 0.01), (458, 0, 0.01), (5000, 20, 0.005), (5000, 8, 0.005), (3000, 149, 0.05), (21, 3, 0.3), (20, 3, 0.3)])
def test_exact_binomial_tail(spark, n, k, rate):
    p = Fraction(str(rate))
    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for level in (0.01, 0.05, float(tail) * 0.999, float(tail) * 1.001):
        if k < n * rate:
            found = spark.range(1).select(quality.refuted(F.lit(n).cast("long"), F.lit(k).cast("long"), rate, level).alias("x")).first().x
            assert found == (tail <= level), (float(tail), level)


@pytest.mark.parametrize(("n", "deviations"), [(10**8, 2.75), (2 * 10**9, 2.75), (2 * 10**9, 0.5), (10**10, 3.5)])
def test_tail_of_many_labels(spark, n, deviations):
    """Against the normal approximation with its skewness term, which is right to a few parts in 1e5 here."""
    rate = 0.005
    sd = math.sqrt(n * rate * (1 - rate))
    k = int(n * rate - deviations * sd)
    z = (k + 0.5 - n * rate) / sd
    tail = 0.5 * math.erfc(-z / math.sqrt(2)) - (1 - 2 * rate) / (6 * sd) * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    for level, said in ((tail * 0.999, False), (tail * 1.001, True)):
        assert spark.range(1).select(quality.refuted(F.lit(n).cast("long"), F.lit(k).cast("long"), rate, level).alias("x")).first().x == said


def corpus(spark, n=3000, bad=0.2, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        poor = rng.random() < bad
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(15, 40))]
        docs.append((i, " ".join(f"{w}###" if poor else w for w in words), rng.choice(("en", "xx" if i % 50 == 0 else "en")), 1, "x"))
        if rng.random() < 0.7:
            labels.append((i, int(not poor)))
    labels += [(1, None), (None, 1), (2, 0), (n + 5, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_thresholds_keep_the_good_and_drop_the_poor(spark):
    docs, labels = corpus(spark)
    found = quality.judge(docs, labels)
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = {r.doc_id: r for r in found.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    poor = [i for i, r in rows.items() if r.n_symbols and lang[i] == "en"]
    good = [i for i, r in rows.items() if not r.n_symbols and not r.base_failed]
    assert not any(rows[i].kept for i in poor)
    assert sum(not rows[i].kept for i in good) <= quality.RISK * len(good)
    assert all(rows[i].kept for i in rows if lang[i] == "xx" and not rows[i].base_failed)  # too few labels to reject anyone


def test_equals_its_sql(spark):
    docs, labels = corpus(spark, 2500)
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", labels.toPandas())
    found = quality.judge(docs, labels)
    assert sorted(map(tuple, c.sql(quality.oracle()).select(*[duckdb.ColumnExpression(x) for x in found.columns]).fetchall())) == sorted(map(tuple, found.collect()))


def test_no_labels_no_rows_and_no_python_in_the_plan(spark):
    docs, labels = corpus(spark, 60)
    none = quality.judge(docs, labels.where("false"))
    assert all(r.kept != r.base_failed for r in none.collect())
    assert quality.judge(docs.where("false"), labels).count() == 0
    for frame in (none, quality.base_counts(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
