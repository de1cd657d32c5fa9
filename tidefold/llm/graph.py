"""Connected components of large graphs, and groups of sorted rows inside a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that an edge names; label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label's own label, so
    paths halve; it ends when a round changes nothing.  Sums and minima are taken before rows are
    shuffled, so a node with very many edges is no hot spot, and nothing reaches the driver.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = materialize(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = table = materialize(links.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("y"), F.col("label").alias("seen"))
        near = links.join(seen, "y").groupBy("x").agg(F.min("seen").alias("near")).withColumnRenamed("x", "node")
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        after = low.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved"))
        after = materialize(after, "labels")
        moved = after.where("moved").limit(1).count() > 0
        release(table)
        table, labels = after, after.drop("moved")
        if not moved:
            release(links)
            return labels


def sorted_groups(batches, key: str):
    """From batches sorted by `key`: (batch, [(start, stop), ...]) with every group whole."""
    import numpy as np
    import pyarrow as pa

    held: list = []

    def whole(parts):
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        return batch, list(zip([0, *cuts], [*cuts, batch.num_rows], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if keys[0] == keys[-1] and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)  # nothing but the group at hand
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        held.append(batch.slice(0, last))
        yield whole([h for h in held if h.num_rows])
        held = [batch.slice(last)]
    if held:
        yield whole(held)


class Parts:
    """Disjoint parts of 0 ... n - 1 by label (`of`); `join` says whether it joined two."""

    def __init__(self, n: int):
        import numpy as np

        self.of = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == max(a, b)] = min(a, b)
        return True
