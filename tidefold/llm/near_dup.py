"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

1.  Every text becomes the set of its 5-word shingles (64-bit hashes).  Texts with equal sets are
    one class; everything below works on one representative per class, so copies cost nothing.
2.  A representative has 128 minwise tokens.  Each of `ROOTS` independent trees sends it to the
    node named by one token; nodes of one member vanish.
3.  A node of at most `LEAF` members is compared exhaustively on one-byte tokens; it yields
    what its likely pairs connect, never the pairs themselves.  A larger node is compared
    with one pivot, which relieves it of all members whose links the pivot already accounts for
    (Jaccard distance is a metric), and then branches: each member goes to two children, by two
    more tokens that its path hasn't used.  Nodes above `TASK` members branch as tables, two levels
    at a time and spread over all tasks; from there on a task follows a node's branches to their
    ends.  Members that a pivot has linked go down as linked.  Near copies share most tokens, so
    that rows would double faster than nodes shrink: a large node whose members share `DENSE` of
    their tokens, and what is still large after `LEVELS` branchings, doesn't branch; blocks of
    `NODE_BLOCK` members are compared exhaustively, inside and against each other.
4.  The likely pairs span clusters.  In a cluster the full sets meet once: pairs that aren't
    connected yet are confirmed exactly.  Clusters above `CLUSTER` members are relieved by
    pivots in the same way, on exact distances, and then compared block against block.
5.  The confirmed links span the components.

A pair of similarity s shares a root with probability s, and then each of two children with
probability s again.  Such a process ends without a common leaf with probability 1/9 at s = 0.75,
however deep the tree, so a tree finds the pair with at least 0.75 * 8/9 and all trees miss it
with (1/3) ** ROOTS = 2e-6 at most; the one-byte estimate misses it with about 4e-5.

Defined results: null and empty texts have an empty set (n_shingles 0) and are alone in their
component; fewer than 5 words are one shingle; rows that repeat a doc_id are judged by their own
text, and share the id's verdict where their text is the same; null doc_ids never lend a component
its name; very long texts are one set like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import map_arrow, materialize, release, row_slices, small_enough, text_or_empty, tidy
from tidefold.llm.graph import Parts, connected_components, sorted_groups

WORDS = 5
TOKENS = 128
ROOTS = 12
LEAF = 32
TASK = 1000
LEVELS = 10
CLUSTER = 250
ROUNDS = 1  # of pivots for large clusters
BLOCK = 125
SHORT = 4  # times as many members fit a block if their sets are as much smaller than MEMBER_BYTES
NODE_BLOCK = 8000  # members of a dense node that are compared at once, on one-byte tokens
DENSE = 0.5  # a member goes to two children a level, so above this share of equal tokens a node's rows grow as it branches
PROBES = 8  # members of a large node that show its density
MEMBER_BYTES = 16 << 10  # of shingles; larger sets count as several members of a cluster
LIKELY = 0.6  # the limit of 0.75 less four standard errors of the estimate from 128 tokens
SLACK = 0.35  # link distance 0.25 and what estimates may err
MOST_IDS = 1_000_000
MOST_PIVOTS = 2_000
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < WORDS:
        h = mix(np.concatenate((h, [np.uint64(len(words))])))
        total = np.zeros(1, dtype=np.uint64)
        for x in h:
            total = mix(total * M3 + x)
        return total
    n = len(h) - WORDS + 1
    total = h[:n].copy()
    for k in range(1, WORDS):
        total = total * M3 + h[k:k + n]
    return np.unique(mix(total))


def set_name(s: np.ndarray) -> int:
    """A 64-bit name of a set, whatever the order of its members."""
    a, b = mix(s + M3).sum(dtype=np.uint64), mix(s ^ M2).sum(dtype=np.uint64)
    return int((a ^ (b << np.uint64(1))).view(np.int64))


def tokens(s: np.ndarray) -> np.ndarray:
    """The minwise tokens; long sets go in slices, so memory stays bounded."""
    out = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, np.multiply.outer(multipliers(), s[i:i + 4096]).min(axis=1))
    return out


def small_tokens(t: np.ndarray) -> bytes:
    """A byte of each token."""
    return (mix(t) & np.uint64(255)).astype(np.uint8).tobytes()


def root_nodes(t: np.ndarray) -> np.ndarray:
    return mix(t[:ROOTS] + M3 * np.arange(1, ROOTS + 1, dtype=np.uint64)).view(np.int64)


def named_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class id, root nodes, one-byte tokens of every row (null for empty sets)."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in row_slices(whole):
                n, cid, roots, small = [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    if not len(s):
                        for x in (cid, roots, small):
                            x.append(None)
                        continue
                    t = tokens(s)
                    cid.append(set_name(s))
                    roots.append(root_nodes(t))
                    small.append(small_tokens(t))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(small, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "cid", "roots", "tokens"])

    return map_arrow(named_texts(docs), run, "doc_id long, text_hash long, n_shingles long, cid long, roots array<long>, tokens binary")


def token_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)


def likely_pairs(matrix: np.ndarray, sizes: np.ndarray, at: np.ndarray, parts: Parts, left: int | None = None) -> None:
    """Joins the pairs among `at` that may reach the limit; with `left`, pairs across that border only."""
    m, least = len(at), LIKELY * TOKENS
    for i in range(m - 1 if left is None else left):
        others = at[i + 1 if left is None else left:]
        n, own = sizes[others], sizes[at[i]]
        apart = others[(parts.of[others] != parts.of[at[i]]) & (4 * np.minimum(n, own) >= 3 * np.maximum(n, own))]
        if not len(apart):
            continue
        same = np.count_nonzero(matrix[apart] == matrix[at[i]], axis=1)
        for j in apart[same >= least].tolist():
            parts.join(int(at[i]), j)


@functools.lru_cache(maxsize=None)
def token_place(tree: int, child: int) -> int:
    """The token that leads to a child of a tree (its root is 1, the children of h are 2 h and 2 h + 1); none twice on a path."""
    taken, above = {tree}, child >> 1
    while above > 1:
        taken.add(token_place(tree, above))
        above >>= 1
    order = np.random.default_rng([tree, child]).permutation(TOKENS)
    return next(x for x in order.tolist() if x not in taken)


def settled(same: np.ndarray) -> np.ndarray:
    """Of a node's members, by the tokens they share with its pivot (the first), those it needn't follow any further; see `relieve`."""
    s = same / TOKENS
    outside = s < LIKELY
    out = ~outside & (s > (s[outside].max() + SLACK if outside.any() else -1.0))
    out[0] = True
    return out


def follow(matrix: np.ndarray, sizes: np.ndarray, tree: int, place: int, known: np.ndarray | None = None) -> tuple[Parts, int]:
    """What the branches of one node connect by likely pairs, and how deep they go; members of one `known` part are linked already."""
    parts, deepest = known_parts(known) if known is not None else Parts(len(matrix)), place.bit_length() - 1
    todo = [(np.arange(len(matrix)), place)]
    while todo:
        at, place = todo.pop()
        deepest = max(deepest, place.bit_length() - 1)
        if len(at) <= LEAF or place >= 1 << LEVELS:
            likely_pairs(matrix, sizes, at, parts)
            continue
        same = np.count_nonzero(matrix[at] == matrix[at[0]], axis=1)
        for j in at[1:][same[1:] >= LIKELY * TOKENS].tolist():
            parts.join(int(at[0]), j)
        at = at[~settled(same)]
        for child in (2 * place, 2 * place + 1):
            token = matrix[at, token_place(tree, child)]
            order = np.argsort(token, kind="stable")
            for some in np.split(at[order], np.flatnonzero(np.diff(token[order])) + 1):
                if len(some) > 1 and (parts.of[some] != parts.of[some[0]]).any():
                    todo.append((some, child))
    return parts, deepest


def known_parts(label: np.ndarray) -> Parts:
    """Members with one label are linked already."""
    parts = Parts(len(label))
    _, first, part = np.unique(label, return_index=True, return_inverse=True)
    parts.of = first[part]
    return parts


def centres(label: np.ndarray, parts: Parts) -> np.ndarray:
    """Of each member the smallest label in its part."""
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, parts.of, label)
    return least[parts.of]


def stars(label: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each label in a part to the smallest there: few, and the same ones from many nodes."""
    edges = np.unique(np.stack((label, centres(label, parts)), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return edges[:, 0], edges[:, 1]


def deal(rows: DataFrame, key: str) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, key).sortWithinPartitions(key)


def compare_nodes(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of likely pairs inside each node; a task follows a node of at most TASK members by itself."""

    def run(batches):
        import pyarrow as pa

        for batch, groups in sorted_groups(batches, "node"):
            matrix, sizes = token_matrix(batch.column("tokens")), batch.column("n").to_numpy()
            trees, places, part = (batch.column(c).to_numpy() for c in ("tree", "place", "part"))
            a, b = [], []
            for start, stop in groups:
                if stop - start < 2:
                    continue
                x, y = stars(part[start:stop], follow(matrix[start:stop], sizes[start:stop], int(trees[start]), int(places[start]), part[start:stop])[0])
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return map_arrow(deal(rows.select("node", "tree", "place", "cid", "part", "n", "tokens"), "node"), run, "a long, b long")


def compare_blocks(rows: DataFrame, key: str, members: str, most: int, judge, name: str) -> DataFrame:
    """Edges of groups too large for one task; judge(part of a batch, its labels, border) gives Parts.

    The group's members (cid, part, ...) fall into ceil(members / most) blocks by hash.  Each block is first
    compared inside, which leaves it few labels, and then with every other block of its group across the border.
    """
    columns, n = [c for c in rows.columns if c != members], max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = F.ceil(F.col(members) / most).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(7)), blocks)).withColumn("block", F.xxhash64(key, "own"))

    def inside(batches):
        import pyarrow as pa

        for batch, groups in sorted_groups(batches, "block"):
            label = batch.column("part").to_numpy().copy()
            for start, stop in groups:
                label[start:stop] = centres(label[start:stop], judge(batch.slice(start, stop - start), label[start:stop], None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.int64())], names=[*batch.schema.names, "label"])

    def across(batches):
        import pyarrow as pa

        for batch, groups in sorted_groups(batches, "pair"):
            second, label, a, b = batch.column("second").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(), [], []
            for start, stop in groups:
                border = int(np.searchsorted(second[start:stop], True))
                if 0 < border < stop - start:
                    x, y = stars(label[start:stop], judge(batch.slice(start, stop - start), label[start:stop], border))
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    dealt = rows.repartition(n, "block").sortWithinPartitions("block")
    dealt = materialize(map_arrow(dealt, inside, T.StructType([*dealt.schema.fields, T.StructField("label", T.LongType())])), name)
    edges = dealt.where(F.col("part") != F.col("label")).select(F.col("part").alias("a"), F.col("label").alias("b"))
    pairs = dealt.withColumn("part", F.col("label")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other")
    pairs = pairs.select(*columns, F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).alias("second"))
    return map_arrow(pairs.repartition(n, "pair").sortWithinPartitions("pair", "second"), across, "a long, b long").unionByName(edges)


def likely_blocks(part, label: np.ndarray, border: int | None) -> Parts:
    parts = known_parts(label)
    likely_pairs(token_matrix(part.column("tokens")), part.column("n").to_numpy(), np.arange(len(label)), parts, border)
    return parts


def likely_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between class ids that connect every pair of similar classes; fewer than the members of all nodes."""
    facts = classes.select("cid", F.col("cid").alias("part"), F.col("n_shingles").alias("n"), "tokens")
    entries = materialize(classes.select("cid", F.posexplode("roots").alias("tree", "node")).select("cid", "node", "tree", F.lit(1).alias("place")), "entries-0")
    edges, small, done = None, [], []
    for level in range(0, LEVELS + 2, 2):
        nodes = materialize(entries.groupBy("node").agg(F.count("*").alias("members"), F.min("cid").alias("pivot")).where("members > 1"), f"nodes-{level}")
        done += [entries, nodes]
        big = nodes.where(F.col("members") > TASK)
        more = big.limit(1).count() > 0
        big = F.broadcast(big) if small_enough(big, MOST_PIVOTS) else big  # a row per large node; joined by shuffle beyond that
        rest = entries.join(big, "node", "left_anti") if more else entries
        if not level:  # most roots have one member
            rest = rest.join(nodes.where(F.col("members") <= TASK), "node", "left_semi").join(facts, "cid")
        small.append(rest.select("node", "tree", "place", "cid", "part", "n", "tokens"))
        if not more:
            break
        large = entries.join(big, "node")
        large = large if level else large.join(facts, "cid")
        if level >= LEVELS:
            of_pivots, entries = compare_blocks(large.select("node", "cid", "part", "n", "tokens", "members"), "node", "members", NODE_BLOCK, likely_blocks, "node-blocks"), None
        else:
            large = materialize(with_estimates(large), f"large-{level}")
            dense = materialize(dense_nodes(large), f"dense-{level}")
            of_pivots = large.where((F.col("s") >= LIKELY) & (F.col("part") != F.col("pivot_part"))).select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
            now = F.when(F.col("s") >= LIKELY, F.col("pivot_part")).otherwise(F.col("part"))
            left = relieve(large.withColumn("part", now), LIKELY, SLACK)
            if dense.limit(1).count():
                whole = F.broadcast(dense) if small_enough(dense, MOST_PIVOTS) else dense
                of_pivots = of_pivots.unionByName(compare_blocks(left.join(whole, "node").select("node", "cid", "part", "n", "tokens", "members"), "node", "members", NODE_BLOCK, likely_blocks, f"dense-blocks-{level}"))
                left = left.join(whole, "node", "left_anti")
            entries = materialize(branch(left), f"entries-{level + 2}")
            done += [large, dense]
        edges = of_pivots if edges is None else edges.unionByName(of_pivots)
        if entries is None:
            break
    found = compare_nodes(functools.reduce(DataFrame.unionByName, small))
    found = materialize(found if edges is None else found.unionByName(edges), "likely")
    release(*done)
    return found


def with_estimates(large: DataFrame) -> DataFrame:
    """Adds s, the estimated similarity to the node's pivot, and the pivot's part."""
    pivots = large.where(F.col("cid") == F.col("pivot")).select("node", F.col("tokens").alias("of_pivot"), F.col("part").alias("pivot_part"))
    if small_enough(pivots, MOST_PIVOTS):  # a row per large node; joined by shuffle beyond that
        pivots = F.broadcast(pivots)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                same = np.count_nonzero(token_matrix(batch.column("tokens")) == token_matrix(batch.column("of_pivot")), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:9], pa.array(same / TOKENS, pa.float64())], names=[*batch.schema.names[:9], "s"])

    rows = large.join(pivots, "node").select("node", "tree", "place", "cid", "part", "n", "pivot", "pivot_part", "tokens", "of_pivot")
    return map_arrow(rows, run, "node long, tree int, place int, cid long, part long, n long, pivot long, pivot_part long, tokens binary, s double")


def dense_nodes(large: DataFrame) -> DataFrame:
    """node, members of the nodes where two of PROBES members share DENSE of their tokens on average."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                probes = token_matrix(batch.column("probes")).reshape(-1, PROBES, TOKENS)
                share = np.mean([(probes[:, i] == probes[:, j]).mean(axis=1) for i in range(PROBES) for j in range(i)], axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(share, pa.float64())], names=["node", "members", "share"])

    probes = [F.min_by("tokens", F.xxhash64("cid", F.lit(k))) for k in range(PROBES)]
    nodes = large.groupBy("node").agg(F.count("*").alias("members"), F.concat(*probes).alias("probes"))
    return map_arrow(nodes, run, "node long, members long, share double").where(F.col("share") >= DENSE).select("node", "members")


def relieve(rows: DataFrame, linked: float, slack: float, key: str = "node") -> DataFrame:
    """Without the members whose links the pivot settles.

    Members with s >= linked are connected with the pivot.  Such a member can still be needed to
    connect one that isn't, but only one at least as near to it as a link: s at most the largest s of
    the others plus `slack`.  The pivot itself has met everyone.
    """
    outside = rows.where(F.col("s") < linked).groupBy(key).agg(F.max("s").alias("nearest"))
    if small_enough(outside, MOST_PIVOTS):
        outside = F.broadcast(outside)
    kept = rows.where(F.col("cid") != F.col("pivot")).join(outside, key)
    return kept.where((F.col("s") < linked) | (F.col("s") <= F.col("nearest") + slack)).drop("nearest")


def branch(rows: DataFrame) -> DataFrame:
    """Each row (node, tree, place, cid, part, n, tokens) at the four grandchildren of its node."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, node = token_matrix(batch.column("tokens")), batch.column("node").to_numpy().view(np.uint64)
            trees, place = batch.column("tree").to_numpy().tolist(), batch.column("place").to_numpy()

            def below(name, child):
                at = [token_place(t, c) for t, c in zip(trees, child.tolist(), strict=True)]
                return mix(name * M3 + child.astype(np.uint64) * np.uint64(256) + matrix[np.arange(len(at)), at])

            for side in (0, 1):
                child = 2 * place + side
                name = below(node, child)
                for end in (0, 1):
                    last = 2 * child + end
                    kept = [batch.column(c) for c in ("tree", "cid", "part", "n", "tokens")]
                    yield pa.RecordBatch.from_arrays([pa.array(below(name, last).view(np.int64)), pa.array(last.astype(np.int32)), *kept], names=["node", "place", "tree", "cid", "part", "n", "tokens"])

    return map_arrow(rows.select("node", "tree", "place", "cid", "part", "n", "tokens"), run, "node long, place int, tree int, cid long, part long, n long, tokens binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on full sorted sets."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(len(a) + len(b) - common, 1)


def confirmed(rows, label: np.ndarray, border: int | None = None) -> Parts:
    """What the confirmed links connect; with `border`, those across it.  The likeliest pairs come first."""
    matrix, sets = token_matrix(rows.column("tokens")), as_sets(rows.column("shingles"))
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    parts, least = known_parts(label), LIKELY * TOKENS
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(m - 1 if border is None else border):
        start = i + 1 if border is None else border
        same = np.count_nonzero(matrix[start:] == matrix[i], axis=1)
        n = sizes[start:]
        j = np.flatnonzero((same >= least) & (4 * np.minimum(n, sizes[i]) >= 3 * np.maximum(n, sizes[i])))
        found.append((same[j].astype(np.int16), np.full(len(j), i, dtype=np.int32), (start + j).astype(np.int32)))
    if not found:
        return parts
    same, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-same, kind="stable")
    for a in range(0, len(order), 5000):
        some = order[a:a + 5000]
        for k in some[parts.of[left[some]] != parts.of[right[some]]].tolist():
            i, j = int(left[k]), int(right[k])
            if parts.of[i] != parts.of[j] and linked(sets[i], sets[j]):
                parts.join(i, j)
    return parts


def as_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, cid, tokens and the full set of each representative in `members` (doc_id, text_hash, cid, cluster)."""
    ids = members.select(F.col("doc_id").alias("rep"), F.col("text_hash").alias("rep_text"), "cid", "cluster")
    if small_enough(ids, MOST_IDS):  # four longs each; beyond that texts and ids meet by shuffle
        ids = F.broadcast(ids)

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()  # rows that repeat the representative's id and text count once
        for whole in batches:
            for batch in row_slices(whole):
                rows = []
                for cluster, cid, text in zip(*[batch.column(c).to_pylist() for c in ("cluster", "cid", "text")], strict=True):
                    if cid in seen:
                        continue
                    s = shingle_set(text)
                    seen.add(cid)
                    rows.append((cluster, cid, small_tokens(tokens(s)), s.tobytes()))
                clusters, cids, small, sets = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(cids, pa.int64()), pa.array(small, pa.binary()), pa.array(sets, pa.binary())], names=["cluster", "cid", "tokens", "shingles"])

    rows = named_texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_text"))).select("cluster", "cid", "text")
    return map_arrow(rows, run, "cluster long, cid long, tokens binary, shingles binary")


def confirmed_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of confirmed links that span every component; `rows` from full_sets."""

    def small(batches):
        import pyarrow as pa

        for batch, groups in sorted_groups(batches, "cluster"):
            a, b, label = [], [], batch.column("part").to_numpy()
            for start, stop in groups:
                x, y = stars(label[start:stop], confirmed(batch.slice(start, stop - start), label[start:stop]))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    def against_pivot(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                s = [similarity(x, y) for x, y in zip(as_sets(batch.column("shingles")), as_sets(batch.column("of_pivot")), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s, pa.float64())], names=[*batch.schema.names[:5], "s"])

    columns, found, rows = ["cluster", "cid", "part", "tokens", "shingles"], None, rows.withColumn("part", F.col("cid"))
    for level in range(ROUNDS + 1):
        bulk = F.ceil(F.sum(F.octet_length("shingles")) / MEMBER_BYTES).cast("long")
        load = F.greatest(F.ceil(F.count("*") / SHORT).cast("long"), bulk)
        sizes = rows.groupBy("cluster").agg(F.greatest(F.count("*"), bulk).alias("members"), load.alias("load"), F.min("cid").alias("pivot"))
        large_sizes = materialize(sizes.where(F.col("members") > CLUSTER), f"large-clusters-{level}")
        few = small_enough(large_sizes, MOST_PIVOTS)
        tagged = rows.join(F.broadcast(large_sizes) if few else large_sizes, "cluster", "left")
        edges = map_arrow(deal(tagged.where(F.col("members").isNull()).select(*columns), "cluster"), small, "a long, b long")
        large = tagged.where(F.col("members").isNotNull())
        more = large_sizes.limit(1).count() > 0
        if more and level == ROUNDS:
            edges = edges.unionByName(compare_blocks(large.select(*columns, "load"), "cluster", "load", BLOCK, confirmed, "cluster-blocks"))
        elif more:
            pivots = large.where(F.col("cid") == F.col("pivot")).groupBy("cluster").agg(F.first("shingles").alias("of_pivot"))
            met = large.join(pivots, "cluster").select("cluster", "cid", "pivot", "tokens", "shingles", "of_pivot")
            met = materialize(map_arrow(met, against_pivot, "cluster long, cid long, pivot long, tokens binary, shingles binary, s double"), f"pivots-{level}")
            edges = edges.unionByName(met.where((F.col("s") >= 0.75) & (F.col("cid") != F.col("pivot"))).select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
            rows = relieve(met, 0.75, 0.25 + 1e-9, "cluster").withColumn("part", F.when(F.col("s") >= 0.75, F.col("pivot")).otherwise(F.col("cid"))).select(*columns)
        found = edges if found is None else found.unionByName(edges)
        if not more:
            break
    return materialize(found, "confirmed")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cid (null for empty sets), component (a class id) and component_id of every row."""
    rows = materialize(sketch(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(first.alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    classes = materialize(classes.select("cid", "rep.doc_id", "rep.text_hash", "n_shingles", "roots", "tokens"), "classes")
    clusters = connected_components(likely_edges(classes)).select(F.col("node").alias("cid"), F.col("label").alias("cluster"))
    members = materialize(classes.select("cid", "doc_id", "text_hash").join(clusters, "cid"), "clusters")
    sets = materialize(full_sets(docs, members), "sets")
    edges = confirmed_edges(sets)
    release(sets)
    links = connected_components(edges).select(F.col("node").alias("cid"), F.col("label").alias("component"))
    named = classes.select("cid", "doc_id").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")  # apart, so that the join can split a large component
    named = named.join(smallest, "component").select("cid", "component", "component_id")
    out = rows.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    return out.select("doc_id", "n_shingles", "cid", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


@tidy
def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    out = judged(docs).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_names(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with the class id of each row's text as _cid."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in row_slices(whole, column=text):
                sets = [shingle_set(t or "") for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_name(s) if len(s) else None for s in sets], pa.int64())], names=[*batch.schema.names, "_cid"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("_cid", T.LongType())]))


@tidy
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, of one document in each component, and all without words.

    The smallest doc_id stays (null ones come last, then the smallest class id).  Of rows that repeat
    a doc_id, each is judged by its own text, and of those with the same shingles one stays, the one
    with the smallest hash of all its columns.
    """
    rows = materialize(judged(docs).select("doc_id", "cid", "component"), "judged")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "cid")
    best = rows.where(F.col("cid").isNotNull()).groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.cid").alias("cid"), F.col("best.doc_id").alias("best_id"))
    verdicts = rows.join(best.withColumnsRenamed({"cid": "c", "best_id": "b"}), F.col("cid").eqNullSafe(F.col("c")) & F.col("doc_id").eqNullSafe(F.col("b")), "left")
    verdicts = materialize(verdicts.select("doc_id", "cid", (F.col("cid").isNull() | F.col("c").isNotNull()).alias("stays")), "verdicts")
    odd = verdicts.where(F.col("cid").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd"))
    odd = materialize(odd, "repeated-ids")
    gone = verdicts.where(~F.col("stays")).select(F.col("doc_id").alias("_gone")).join(odd, F.col("_gone").eqNullSafe(F.col("_odd")), "left_anti").distinct()
    gone = materialize(gone.where(F.col("_gone").isNotNull()), "gone")
    by_size = lambda df: F.broadcast(df) if small_enough(df, MOST_IDS) else df  # noqa: E731  8 bytes each; beyond that by shuffle
    columns = [f"c{i}" for i in range(len(docs.columns))]  # whatever they are called
    numbered = docs.toDF(*columns)
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    key = F.col(doc_id).cast("long")
    if not odd.limit(1).count():
        return numbered.join(by_size(gone), key == F.col("_gone"), "left_anti").toDF(*docs.columns)
    plain = numbered.join(by_size(gone.unionByName(odd.select(F.col("_odd").alias("_gone")))), key.eqNullSafe(F.col("_gone")), "left_anti")
    # rows with a repeated or null id: judged by their own text
    again = numbered.join(by_size(odd), key.eqNullSafe(F.col("_odd")), "left_semi")
    again = materialize(class_names(again, text).withColumn("_id", key), "repeated-rows")
    empty = again.where(F.col("_cid").isNull()).select(*columns)
    stay = verdicts.where("stays AND cid IS NOT NULL").select(F.col("doc_id").alias("s"), F.col("cid").alias("t"))
    again = again.join(stay, F.col("_id").eqNullSafe(F.col("s")) & (F.col("_cid") == F.col("t")), "left_semi")
    one = again.groupBy("_id", "_cid").agg(F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns)))).alias("row")).select("row.*")
    return plain.unionByName(empty.unionByName(one)).toDF(*docs.columns)
