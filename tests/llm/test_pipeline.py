"""The pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
from tidefold.llm import queries


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n, before = docs.columns, docs.count(), {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns and after.dtypes == docs.dtypes
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0.8 * n <= after.count() <= docs.count(), name
        assert after.exceptAll(docs).count() == 0
        docs = after
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = {r.doc_id for r in docs.collect()}
    assert len(toxic & left) <= 0.3 * len(toxic & before)
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left


def test_pipeline_of_no_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_a_plain_version_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns named like the operators' own."""
    from test_near_dup import plain

    from pyspark.sql import functions as F
    from tidefold.llm import langid, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(40).collect()
    long = " ".join(r.text for r in some if r.text)
    odd = [(None, some[0].text, "en", "src0", 1), (None, None, None, None, None), (some[1].doc_id, some[1].text, some[1].lang, "src1", 1), (some[2].doc_id, some[3].text, None, "", 0), (9001, "", "en", "src0", 0), (9002, long, "en", None, 1), (9003, "123 %% 456", "en", "src0", 9), (9004, some[5].text, some[5].lang, "x.example.com", 4)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"cid": F.lit("x"), "_host": F.lit(1), "_cid": F.lit(2), "key": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = lambda rows: sorted(map(str, rows))
    (_, language), (_, clean), (_, one), (_, packed) = corpus_pipeline.STAGES

    kept = language(spark, docs, str(tmp_path)).collect()
    of_host, of_all = {}, {}
    for r in docs.collect():
        if r.lang:
            of_host.setdefault((r.source or None), {}).setdefault(r.lang, 0)
            of_host[r.source or None][r.lang] += 1
            of_all[r.lang] = of_all.get(r.lang, 0) + 1
    model = langid.with_priors(docs, "doc_id", "lang", "source")[1]
    assert dict(zip(model.languages, model.totals.tolist(), strict=True)) == of_all
    def kept_by_hand(r):
        domain = ".".join(r.source.split(".")[-2:]) if r.source and "." in r.source else None
        host, at = (of_host.get(r.source) if r.source else None), None
        if domain and domain != r.source:
            at = {}
            for h, counts in of_host.items():
                if h and h.endswith(domain):
                    for lang, n in counts.items():
                        at[lang] = at.get(lang, 0) + n
        spread = lambda c: None if c is None else model.spread(list(c.items()))
        return langid.judge(model, r.text, r.lang, r.source, spread(host), spread(at), 0.5, None)[3]
    assert text(kept) == text(r for r in docs.collect() if kept_by_hand(r))

    docs = spark.createDataFrame(kept, docs.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    kept = clean(spark, docs, str(tmp_path)).collect()
    assert text(kept) == text(r for r in docs.collect() if model.score(r.text or "") < 0.5)

    docs = spark.createDataFrame(kept, docs.schema)
    found = one(spark, docs, str(tmp_path)).collect()
    rows = docs.collect()
    component = plain([(i, r.text) for i, r in enumerate(rows)])
    groups = {}
    for i, n, c in component:
        groups.setdefault(c if n else ("empty", i), []).append(rows[i])
    assert len(found) == len(groups)
    for members in groups.values():
        best = min((r.doc_id is None, r.doc_id or 0) for r in members)
        assert sum(str(r) in {str(m) for m in members if (m.doc_id is None, m.doc_id or 0) == best} for r in found) >= 1

    docs = spark.createDataFrame(found, docs.schema)
    pieces = packed(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.piece == 0) == sorted(str(r.doc_id) for r in found)


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_registered_queries_equal_their_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, sf)
        expected = c.sql(sql)
        assert sorted(expected.columns) == sorted(found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(expected.select(*[duckdb.ColumnExpression(x) for x in found.columns]).fetchall()), name
