"""op6 against all pairs on exact sets, with limits small enough that every branch of the search is taken."""

import random

import numpy as np
import pytest

from tidefold.llm import graph, near_dup

SCHEMA = "doc_id long, text string, cid string, n int, tokens int"  # with names that the operator uses itself


def plain(rows):
    """doc_id -> (n_shingles, component) by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root(i) != root(j):
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


def mutate(rng, w, changes):
    w = list(w)
    for _ in range(changes):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(10_000))
    return w


def corpus(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        out.append(words(rng, rng.randint(1, 120)))
    for _ in range(8):
        base = words(rng, rng.randint(40, 150))
        out += [base, base, *[mutate(rng, base, rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]]
    base = words(rng, 100)
    out += [mutate(rng, base, rng.randint(1, 6)) for _ in range(60)]  # a large group of near copies, linked and not
    passage = words(rng, 60)
    out += [words(rng, 30) + passage + words(rng, 30) for _ in range(40)]  # a passage that many share
    texts = [" ".join(w) for w in out] + [None, "", " \t\n", "One two", "one  TWO", "one two three", "É a b c d e", "é a b c d e", "a b\x85c d e f", "a b c d e " * 500]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "only a null has this text of words")]


def found(spark, rows):
    frame = spark.createDataFrame([(d, t, "x", 0, 1) for d, t in rows], SCHEMA)
    out = near_dup.components(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in out)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in out}


def test_equals_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize(("leaf", "task", "cluster", "levels"), [(4, 8, 10, 4), (4, 1000, 8, 10), (3, 6, 6, 0)])
def test_large_nodes_and_clusters(spark, monkeypatch, leaf, task, cluster, levels):
    for name, value in (("LEAF", leaf), ("TASK", task), ("CLUSTER", cluster), ("LEVELS", levels), ("BLOCK", 4)):
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus(2)
    assert found(spark, rows) == plain(rows)


def test_shuffle_paths_beyond_the_broadcast_bounds(spark, monkeypatch):
    for name, value in (("MOST_IDS", 1), ("MOST_PIVOTS", 0), ("LEAF", 4), ("TASK", 8), ("CLUSTER", 10)):
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus(3)
    assert found(spark, rows) == plain(rows)


def test_paths_use_no_token_twice_and_tables_branch_like_tasks(spark):
    for tree in range(near_dup.ROOTS):
        for leaf in (64, 85, 127, 1000):
            path = [leaf >> k for k in range(leaf.bit_length() - 1)]
            assert len({tree, *(near_dup.token_place(tree, h) for h in path)}) == len(path) + 1
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 3, (50, near_dup.TOKENS), dtype=np.uint8)
    rows = [(7, 2, 1, i, i, 9, matrix[i].tobytes()) for i in range(50)]
    out = near_dup.branch(spark.createDataFrame(rows, "node long, tree int, place int, cid long, part long, n long, tokens binary")).collect()
    for place in (4, 5, 6, 7):
        at = [near_dup.token_place(2, place >> 1), near_dup.token_place(2, place)]
        groups, want = {}, {}
        for r in out:
            if r.place == place:
                groups.setdefault(r.node, set()).add(r.cid)
        for i in range(50):
            want.setdefault(tuple(matrix[i, at]), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_recall_of_the_trees_at_the_limit():
    """Pairs at 0.75 in a node of unrelated members: a tree finds two in three, all trees miss next to none."""
    rng = np.random.default_rng(5)
    pairs, fill = 400, 3000
    a = rng.integers(0, 3, (pairs, near_dup.TOKENS), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.75, a, (a + 1 + rng.integers(0, 2, a.shape)) % 3).astype(np.uint8)
    rest = rng.integers(0, 3, (fill, near_dup.TOKENS), dtype=np.uint8)  # few values: nodes stay large for some levels
    matrix = np.concatenate([a, b, rest])
    sizes = np.full(len(matrix), 100)
    close = (a == b).mean(axis=1) >= near_dup.LIKELY
    seen, by_tree = np.zeros(pairs, dtype=bool), []
    for tree in range(near_dup.ROOTS):
        here, deepest = np.zeros(pairs, dtype=bool), 0
        for value in np.unique(matrix[:, tree]):
            at = np.flatnonzero(matrix[:, tree] == value)
            parts, depth = near_dup.follow(matrix[at], sizes[at], tree, 1)
            deepest = max(deepest, depth)
            of = np.arange(len(matrix)) + len(matrix)
            of[at] = parts.of
            here |= of[:pairs] == of[pairs:2 * pairs]
        by_tree.append(here[close].mean())
        seen |= here
        assert deepest >= 3
    assert np.mean(by_tree) > 0.55 and seen[close].mean() > 0.995


def test_the_tables_branch(spark):
    """On sf0.1 some nodes are followed to level 2 and beyond."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = near_dup.sketch(docs).where("cid IS NOT NULL").dropDuplicates(["cid"]).toPandas()
    matrix, roots = np.frombuffer(b"".join(rows.tokens), dtype=np.uint8).reshape(-1, near_dup.TOKENS), np.stack(rows.roots)
    deepest = []
    for tree in range(near_dup.ROOTS):
        names, n = np.unique(roots[:, tree], return_counts=True)
        for name in names[n > near_dup.LEAF]:
            at = np.flatnonzero(roots[:, tree] == name)
            deepest.append(near_dup.follow(matrix[at], rows.n_shingles.to_numpy()[at], tree, 1)[1])
    assert max(deepest) >= 2


def likely_group(spark, kept, seed):
    """Classes whose members keep a share of a base's tokens, and what all their likely pairs connect."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, near_dup.TOKENS, dtype=np.uint8)
    rest = rng.integers(0, 256, (len(kept), near_dup.TOKENS), dtype=np.uint8)
    matrix = np.where(rng.random(rest.shape) < np.asarray(kept)[:, None], base, rest).astype(np.uint8)
    rows = [(i, 100, [int(matrix[i, tree]) * 100 + tree for tree in range(near_dup.ROOTS)], matrix[i].tobytes()) for i in range(len(kept))]
    parts = graph.Parts(len(kept))
    near_dup.likely_pairs(matrix, np.full(len(kept), 100), np.arange(len(kept)), parts)
    return spark.createDataFrame(rows, "cid long, n_shingles long, roots array<long>, tokens binary"), parts.of


@pytest.mark.parametrize("block", [1000, 30])
def test_rows_of_near_copies_do_not_multiply(spark, monkeypatch, block):
    """Members that share most tokens stay in one node however often it branches; members that share few leave it."""
    for name, value in (("TASK", 60), ("NODE_BLOCK", block)):
        monkeypatch.setattr(near_dup, name, value)
    made, plainly = [], near_dup.branch
    monkeypatch.setattr(near_dup, "branch", lambda rows: made.append(plainly(rows).count()) or plainly(rows))
    near = np.random.default_rng(4).beta(6, 2.2, 200)
    for kept, most in ((near, 0), (np.full(200, 0.6), near_dup.ROOTS * 200 * 4)):
        made.clear()
        classes, parts = likely_group(spark, kept, 8)
        edges = near_dup.likely_edges(classes)
        labels = {r.node: r.label for r in graph.connected_components(edges).collect()}
        assert sum(made) <= most and (most == 0 or sum(made) > 0)
        assert [labels.get(i, i) for i in range(200)] == parts.tolist()


def test_blocks_of_a_cluster_hold_as_many_short_sets_as_fit(spark, monkeypatch):
    for name, value in (("CLUSTER", 10), ("BLOCK", 4)):
        monkeypatch.setattr(near_dup, name, value)
    rng, blocks, plainly = random.Random(6), [], near_dup.compare_blocks

    def noted(rows, key, members, most, judge, name):
        if name == "cluster-blocks":
            blocks.append((rows.count(), rows.agg({members: "max"}).first()[0] / most))
        return plainly(rows, key, members, most, judge, name)

    monkeypatch.setattr(near_dup, "compare_blocks", noted)
    base = words(rng, 100)
    rows = [(i, " ".join(mutate(rng, base, rng.randint(1, 5)))) for i in range(60)]
    for size in (near_dup.MEMBER_BYTES, 200):  # sets of some 800 bytes: small, then large
        monkeypatch.setattr(near_dup, "MEMBER_BYTES", size)
        assert found(spark, rows) == plain(rows)
    (n, short), (m, long) = blocks
    assert n == m > 32 and short <= n / 16 + 1 and long >= n * 600 / 200 / 4


def test_empty_table_and_keep_one(spark):
    frame = spark.createDataFrame([(2, "a b c d e f", "k", 1, 1), (1, "A B c d e f", "k", 1, 1), (3, "other words are here too", "k", 1, 1), (4, None, "k", 1, 1), (5, "", "k", 1, 1)], SCHEMA)
    assert near_dup.components(frame.where("false")).count() == 0
    kept = near_dup.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_keep_one_loses_no_text_under_repeated_ids(spark):
    near, other = "a b c d e f", "something else that is here too"
    rows = [(3, near, "k", 1, 1), (5, other, "k", 1, 2), (5, near.upper(), "k", 1, 3), (7, other, "l", 1, 1), (7, other, "k", 1, 1), (None, near, "k", 1, 1), (None, "of a null id alone words", "k", 1, 1), (None, "of a null id alone words", "k", 1, 2), (5, "", "k", 1, 1), (None, None, "k", 1, 1), (8, "one of its own which stays", "k", 1, 1)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("3", near), ("5", other), ("None", "of a null id alone words"), ("5", ""), ("None", ""), ("8", "one of its own which stays")])
    same = near_dup.keep_one(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, same)) == sorted(map(str, kept))
    only = near_dup.keep_one(spark.createDataFrame([(9, near, "k", 1, 1)] * 5, SCHEMA)).collect()
    assert len(only) == 1


def test_scratch_folders_go(spark, monkeypatch):
    from tidefold.llm import common

    before = list(common._made)
    frame = spark.createDataFrame([(i, f"a b c d e f {i // 2}", "k", 1, 1) for i in range(20)], SCHEMA)
    out = near_dup.components(frame)
    mine = [m for m in common._made if m not in before]
    assert out.count() == 20 and len(mine) <= 4
    common.remove(spark, [path for _, path in mine])
    monkeypatch.setattr(near_dup, "confirmed_edges", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        near_dup.components(frame)
    assert list(common._made) == before


def test_threshold_is_exact():
    a, b = np.arange(7, dtype=np.uint64), np.arange(1, 8, dtype=np.uint64)
    assert near_dup.linked(a, b) and not near_dup.linked(np.arange(6, dtype=np.uint64), np.arange(1, 7, dtype=np.uint64))


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, k) for k in range(1001, 1030)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame([*path[::-1], *star, (5, 5)], "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1030)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_stay_whole_over_batches():
    import pyarrow as pa

    keys = [1] * 3 + [2] * 9 + [3] + [4] * 2
    whole = pa.RecordBatch.from_pydict({"k": pa.array(keys), "v": pa.array(range(len(keys)))})
    for size in range(1, 16):
        parts = [whole.slice(i, size) for i in range(0, len(keys), size)]
        groups = [b.slice(s, e - s).column("v").to_pylist() for b, g in graph.sorted_groups(parts, "k") for s, e in g]
        assert groups == [[0, 1, 2], list(range(3, 12)), [12], [13, 14]]
    assert list(graph.sorted_groups([], "k")) == []
