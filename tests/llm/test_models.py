"""op2, op7 and op8: held-out accuracy, defined results, and single functions against plain versions."""

import random
import zlib

import numpy as np

from tidefold.llm import html_pages, html_text, langid, toxicity
from tidefold.llm.ngrams import code_points, hashed

DOCS = "doc_id long, text string, lang string, source string, score string, key int, _host int"


def invented(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(("en", "fr"))
        text = invented(rng, "abcdefghi" if lang == "en" else "hijklmnopé", rng.randint(1, 60)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                text.insert(rng.randint(0, len(text)), rng.choice(("zzqx", "wwvuq")))
        out.append((i, " ".join(text), lang, f"site{i % 3}.example.{'fr' if lang == 'fr' else 'com'}", toxic))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], "s", 1, 2) for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], int(r[4])) for r in rows] + [(rows[0][0], None), (10**9, 1)], "doc_id long, toxic int")


def test_ngrams_are_those_of_the_text():
    points = code_points("Ab\tc")
    assert points.tolist() == [97, 98, 32, 99]
    assert len(hashed(points, (1, 3), 20)) == 6 + 4 and len(hashed(code_points(""), (4,), 20)) == 0
    a, b = hashed(code_points("xidiotx"), (4,), 20), hashed(code_points("yyidiotyy"), (4,), 20)
    assert len(set(a.tolist()) & set(b.tolist())) == 2


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(1500)
    docs = frame(spark, [*rows, (5000, None, "en", "s", False), (5001, "", "en", "s", False), (5002, "zzqx " * 30_000, "en", "s", True), (None, "a b", "en", "s", False), (rows[3][0], rows[3][1], "en", "s", False)])
    scored = toxicity.score(docs, toxicity.train(docs, labels_of(spark, rows), per_class=300)).collect()
    assert len(scored) == len(rows) + 5
    by = {r.doc_id: r for r in scored}
    assert by[None].held_out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    held = [(by[r[0]].predicted, r[4]) for r in rows if by[r[0]].held_out]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert by[5000].score == by[5001].score and by[5002].predicted == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows = corpus(300)
    docs = frame(spark, rows)
    flipped = [(*r[:4], not r[4] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]) for r in rows]
    a, b = toxicity.train(docs, labels_of(spark, rows)), toxicity.train(docs, labels_of(spark, flipped))
    assert a.bias == b.bias and (a.weight == b.weight).all()
    other = frame(spark, [(r[0], r[1], "de", "elsewhere", r[4]) for r in rows])
    assert (toxicity.train(other, labels_of(spark, rows)).weight == a.weight).all()


def test_ratios_scale_the_features(spark):
    texts, y = ["aaaa bbbb", "aaaa cccc", "dddd cccc", "dddd eeee"] * 25, np.array([1, 1, 0, 0] * 25)
    docs = spark.createDataFrame([(i, t, "en", "s", "s", 1, 2) for i, t in enumerate(texts)], DOCS)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int"))
    weight = lambda w: model.weight[hashed(code_points(w), (4,), model.bits)[1]]
    assert weight("aaaa") > 0 > weight("dddd") and weight("cccc") == 0
    assert model.score("aaaa") > 0.9 and model.score("dddd") < 0.1


def test_training_equals_a_plain_version(spark):
    """Every weight and score against dictionaries and loops: presence counts, Dunning's statistic, scaled logistic regression."""
    import math

    rows = corpus(160, seed=8)
    docs = frame(spark, [*rows, (rows[5][0], "~ other text of the same id", "en", "s", False)])
    model = toxicity.train(docs, labels_of(spark, rows), bits=14)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    grams = [set(hashed(code_points(r[1]), toxicity.LENGTHS, 14).tolist()) for r in learned]
    ones = sum(r[4] for r in learned) + (zlib.crc32(str(10**9).encode()) % 5 > 0)
    pos, neg = sum(r[4] for r in learned), sum(not r[4] for r in learned)
    scale = {}
    for g in set().union(*grams):
        a, b = sum(g in s and r[4] for s, r in zip(grams, learned, strict=True)), sum(g in s and not r[4] for s, r in zip(grams, learned, strict=True))
        k, n, g2 = a + b, pos + neg, 0.0
        for seen, of in ((a, pos), (b, neg)):
            for x, total in ((seen, k), (of - seen, n - k)):
                g2 += 2 * x * math.log(x / (total * of / n)) if x else 0.0
        if k >= 3 and g2 >= toxicity.LEAST:
            scale[g] = math.log((a + 1) / (pos + 2) / ((b + 1) / (neg + 2)))
    w, bias = dict.fromkeys(scale, 0.0), 0.0
    m, v, mb, vb = dict.fromkeys(scale, 0.0), dict.fromkeys(scale, 0.0), 0.0, 0.0
    for t in range(1, 151):
        g, gb = {f: 1e-4 * w[f] for f in scale}, 0.0
        for s, r in zip(grams, learned, strict=True):
            mine = [f for f in s if f in scale]
            p = 1 / (1 + math.exp(-(bias + sum(w[f] * scale[f] for f in mine))))
            d = (p - r[4]) * (0.5 / pos if r[4] else 0.5 / neg)
            gb += d
            for f in mine:
                g[f] += d * scale[f]
        rate = 0.05 / (1 - 0.9**t) * math.sqrt(1 - 0.999**t)
        for f in scale:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.999 * v[f] + 0.001 * g[f] ** 2
            w[f] -= rate * m[f] / (math.sqrt(v[f]) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        bias -= rate * mb / (math.sqrt(vb) + 1e-8)
    labelled = len(learned) + (zlib.crc32(str(10**9).encode()) % 5 > 0)
    bias += math.log((ones / labelled + 1e-6) / (1 - ones / labelled + 1e-6))
    assert set(np.flatnonzero(model.weight).tolist()) == set(scale) and len(scale) > 3
    assert all(abs(model.weight[f] - w[f] * scale[f]) < 1e-5 for f in scale) and abs(model.bias - bias) < 1e-6
    for r in toxicity.score(docs, model).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        if r.score == model.score(text):
            s = set(hashed(code_points(text), toxicity.LENGTHS, 14).tolist())
            assert abs(r.score - 1 / (1 + math.exp(-(bias + sum(w[f] * scale[f] for f in s if f in scale))))) < 1e-5


def test_without_labels(spark):
    docs = frame(spark, corpus(20))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} != {None}
    assert toxicity.score(docs.where("false"), toxicity.train(docs, none)).count() == 0
    assert toxicity.keep_clean(docs, toxicity.train(docs, none)).count() == 20


def test_language_of_texts_declarations_and_hosts(spark):
    rows = corpus(600)
    wrong = [(7000, invented(random.Random(5), "abcdefghi", 40), "fr", "site0.example.com"), (7001, None, "en", "site0.example.com"), (7002, "123 ### 456", "en", "site0.example.com"), (7003, "h", None, "only.example.fr"), (7004, invented(random.Random(6), "hijklmnopé", 9000), None, None)]
    docs = frame(spark, [*[r[:4] for r in rows], *wrong])
    found = {r.doc_id: r for r in langid.identify(docs, "doc_id", "lang", "source", sample=400).collect()}
    assert len(found) == len(rows) + len(wrong)
    assert sum(found[r[0]].lang == r[2] for r in rows) >= 0.98 * len(rows) and all(found[r[0]].kept for r in rows)
    assert found[7000].lang == "en" and found[7000].text_lang == "en" and found[7004].lang == "fr"
    assert not found[7001].kept and not found[7002].kept and found[7001].text_lang is None and found[7003].lang == "fr"
    kept = langid.keep_identified(docs, sample=400)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert sorted(map(str, kept.where("doc_id < 50").collect())) == sorted(map(str, docs.where("doc_id < 50").collect()))
    assert langid.identify(docs.where("false"), "doc_id", "lang", "source").count() == 0
    assert not any(r.kept for r in langid.identify(docs.selectExpr("doc_id", "text", "string(null) lang", "source"), "doc_id", "lang", "source").collect())


def test_languages_by_shuffle_where_hosts_are_many(spark, monkeypatch):
    docs = frame(spark, [r[:4] for r in corpus(100)])
    few = sorted(map(tuple, langid.identify(docs, "doc_id", "lang", "source").collect()))
    monkeypatch.setattr(langid, "MOST_HOSTS", 1)
    assert sorted(map(tuple, langid.identify(docs, "doc_id", "lang", "source").collect())) == few


def test_evidence_is_fused_as_stated():
    model = langid.Model(["de", "en"], np.zeros((1 << langid.BITS, 2), dtype=np.float32), totals=np.array([30.0, 70.0]), strength=10.0)
    log = model.prior([9, 1], [10, 10], None)
    corpus_mean = (np.array([30, 70]) + 10 * 0.5) / 110
    domain = (np.array([10, 10]) + 10 * corpus_mean) / 30
    assert np.allclose(np.exp(log), (np.array([9, 1]) + 10 * domain) / 20)
    assert np.allclose(np.exp(model.prior([1, 0], None, "de")), np.exp(model.prior([0, 0], None, "de")) * 0 + (np.array([0, 0]) + 10 * ((np.array([29, 70]) + 5) / 109)) / 10)
    assert langid.judge(model, "same", "de", None, None, None, 0.5, None)[0] == "de"
    assert langid.judge(model, "same", None, "x.de", [1, 1], [1, 1], 0.5, ("en",))[3] is False


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://WWW.Shop.example.de:80/x", "<html LANG='DE-at'><script>var a</script><p>Hallo <b>Welt"), (2, None, None)], "page_id long, url string, html string")
    rows = langid.page_evidence(pages).orderBy("page_id").collect()
    assert (rows[0].declared, rows[0].host, rows[0].text.split()) == ("de", "www.shop.example.de", ["Hallo", "Welt"])
    assert (rows[1].declared, rows[1].host, rows[1].text) == (None, None, "")
    assert langid.identify(langid.page_evidence(pages), "page_id", "declared", "host").count() == 2


def test_html_on_held_out_pages():
    model, good, whole, pages = html_text.default_model(), 0, 0, html_pages.labelled_pages(200, seed=123)
    for html in pages:
        page = html_text.Page(html)
        for state, text, p in zip(page.states(), page.text, model.marginals(page), strict=True):
            if text:
                whole += 1
                good += (p >= 0.5) == (state == html_text.CONTENT)
    assert good >= 0.97 * whole


def test_messages_are_exact_on_small_trees():
    """Marginals against the sum over all assignments of states."""
    import itertools

    model = html_text.default_model()
    html = '<div class="ad"><p>Buy now</p></div><article><h1>Title of it</h1><p>Some longer text, with an end.</p></article><footer>&copy; us</footer>'
    page = html_text.Page(html)
    n = len(page.tag)
    local = []
    for i, found in enumerate(page.features()):
        e = np.sum([model.evidence.get(f, (0, 0, 0)) for f in found], axis=0)
        local.append(np.exp(e) * np.array([1, 1, 0 if page.text[i] else 1]))
    total, content = 0.0, np.zeros(n)
    for states in itertools.product(range(3), repeat=n):
        w = model.root[states[0]]
        for i, s in enumerate(states):
            w *= local[i][s] * (model.edge[1 if page.text[i] else 0][states[page.parent[i]]][s] if i else 1)
        total += w
        content += w * (np.array(states) == html_text.CONTENT)
    assert np.allclose(model.marginals(page), content / total, atol=1e-9)


def test_markup_is_read_as_browsers_do():
    text = lambda html: [t for t in html_text.Page(html).text if t]
    assert text("<p>a &amp; b&nbsp;c&lt;d &am <b>e<br>f<p>g") == ["a & b c<d &am e f", "g"]
    assert text("a < b<ul><li>x<li>y</ul>z<!-- no <p>no</p> --><script>var t='</p>'</script>q") == ["a < b", "x", "y", "zq"]
    assert text('<div title="a>b">in</div><p>out<!-- open') == ["in", "out"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"] and text("<style>p{}") == []
    assert text("<p>one</div>two</p>") == ["onetwo"] and text("") == [] and text("<textarea>field</textarea>yes") == ["field", "yes"]


def test_extraction_of_all_rows(spark):
    page = "<html><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A   title</h1><p>First\nparagraph of some words.</p><p>Second one, which has more words.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "t"), (2, "u", None, "t"), (3, None, "", "t"), (1, "u", page, "t"), (4, "u", page.replace("First", "word " * 40_000), "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract(frame).orderBy("page_id").collect()
    assert found[0] == found[1] and found[0].text == "A title\n\nFirst paragraph of some words.\n\nSecond one, which has more words."
    assert [r.n_chars for r in found] == [len(found[0].text)] * 2 + [0, 0, len(found[0].text) - 5 + 5 * 40_000 - 1] and found[3].url is None
    assert html_text.extract(frame.where("false")).count() == 0


def test_texts_in_no_declared_language_go(spark):
    rows = [r[:4] for r in corpus(400)]
    rng = random.Random(9)
    foreign = [(8000 + i, invented(rng, letters, n), lang, "site0.example.com") for i, (letters, n, lang) in enumerate((a, n, lang) for a in ("qrstuvwxyz", "абвгдежз", "acegikmoqsuwy") for n in (15, 60, 400) for lang in ("en", "fr", None))]
    found = {r.doc_id: r for r in langid.identify(frame(spark, [*rows, *foreign]), "doc_id", "lang", "source").collect()}
    assert all(found[r[0]].kept for r in rows)
    assert not any(found[r[0]].kept or found[r[0]].confidence >= 0.5 for r in foreign)


def test_fitting_on_executors_equals_fitting_at_hand(spark):
    rows = [(r[2], r[1]) for r in corpus(200)] + [("xx", ""), ("xx", "12 34"), ("xx", "solo words of its own")]
    names, totals = ["en", "fr", "xx", "zz"], [5, 6, 7, 8]
    a = langid.fit_rows(spark.createDataFrame(rows, "l string, t string"), names, totals)
    b = langid.fit([t for _, t in rows], [x for x, _ in rows], names, totals)
    assert (a.log_rate == b.log_rate).all() and (a.log_shared == b.log_shared).all() and a.declared_right == b.declared_right
    assert np.allclose(a.usual, b.usual, rtol=1e-12) and a.usual[3, 0] == -np.inf


def test_unseen_ngrams_speak_for_no_language():
    model = langid.fit(["aaa bbb " * 300, "ccc"], ["en", "fr"], ["en", "fr"], [1, 1])
    assert np.allclose(model.text_evidence("zzz")[0][0], model.text_evidence("zzz")[0][1], atol=0.5)


def test_every_declared_language_is_one(spark, monkeypatch):
    """More than 64 languages, the 65th and beyond with few rows and none of them in the sample."""
    rng = random.Random(4)
    rows = [(i, invented(rng, "abcdefghi", 30), f"l{i % 64:02d}", "a.example.com") for i in range(1280)]
    rare = [(2000 + i, invented(rng, ("qrstuvw", "éèêëàâä", "абвгдеж")[i % 3], 30), f"rare{i % 3}", "b.example.com") for i in range(12)]
    docs = frame(spark, [*rows, *rare]).drop("_host")
    by = {r.doc_id: r for r in langid.identify(docs, "doc_id", "lang", "source", sample=200).collect()}
    assert len(by) == 1292 and all(by[r[0]].lang == by[r[0]].text_lang == r[2] and by[r[0]].kept for r in rare)
    out, model = langid.with_priors(docs, "doc_id", "lang", "source", sample=200)
    assert len(model.languages) == 67 and model.totals.sum() == 1292 and isinstance(model.log_rate, langid.Sparse)
    assert dict(out.where("doc_id = 2000").first()._host) == {"rare0": 4, "rare1": 4, "rare2": 4}
    assert len(out.where("doc_id = 2000").first()._domain) == 67
    monkeypatch.setattr(langid, "DENSE", 100)
    dense = langid.with_priors(docs, "doc_id", "lang", "source", sample=200)[1]
    found = hashed(code_points(rare[1][1]), langid.LENGTHS, langid.BITS)
    assert np.allclose(model.log_rate.sum(found), dense.log_rate[found].sum(axis=0), atol=1e-2) and np.allclose(model.log_rate.column(found, 65), dense.log_rate[found, 65])


def test_a_host_that_is_its_own_domain_counts_once(spark):
    docs = frame(spark, [(1, "ab", "en", "src0"), (2, "ab", "en", "example.com"), (3, "ab", "fr", "a.example.com"), (4, "ab", "fr", None)]).drop("_host")
    by = {r.doc_id: r for r in langid.with_priors(docs, "doc_id", "lang", "source")[0].collect()}
    assert [by[i]._domain for i in (1, 2, 3, 4)] == [None, None, {"en": 1, "fr": 1}, None] and by[1]._host == {"en": 1} and by[4]._host is None
