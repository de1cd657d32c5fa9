"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is rotated at random and kept as the signs x of its coordinates (a vector of
+-1/sqrt(D)) with the correction factor f = <x, o>.  For another vector q, <x, q> / f is an
unbiased estimate of <o, q>, and with probability at least 1 - exp(-e * e / 2) or so it errs by
less than e * sqrt((1 - f * f) / (f * f * (D - 1))).  Only pairs whose upper confidence bound
reaches the limit are computed exactly, in double precision.

Pairs meet where their codes agree in one of several independent bands, each from rotations of its
own.  A band's code names the largest coordinates, with their signs, under some rotations, and the
signs of some more.  Its size grows with the logarithm of the number of vectors (so an eighth of the
vectors at most meets an unrelated one in a band, however large the table), and the number of bands
follows from it so that a pair right at the limit meets nowhere with probability `missed` at most.
Only vectors that meet others in a band are sent there.  A pair belongs to the first band where it
meets, which is settled before it is computed, so it is compared once and no list of pairs is needed.

Equal vectors are one class from the start.  A band with more than `BLOCK` classes, such as a
large group of near copies, is dealt out in blocks, and every pair of blocks is a task's work: no
task holds more than two blocks, and nothing is dropped.  Only counts and spanning edges leave it.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, as do vectors of different lengths with each other; ties at the limit link; rows that repeat a vec_id are
vectors of their own but share its component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_arrow, materialize, release, tidy
from tidefold.llm.graph import Parts, connected_components, sorted_groups

LIMIT = 0.95
MISSED = 1e-5
BLOCK = 500
ERROR = 5.0
WIDE = 64
FEW = 32  # members of a bucket whose pairs are listed together with those of others


@functools.lru_cache(maxsize=64)
def agreement(dimension: int, limit: float) -> float:
    """How often two vectors of cosine `limit` have the same largest coordinate, sign included, of `wide(dimension)` under a random rotation; three standard errors on the safe side."""
    rng, m, same, n = np.random.default_rng(dimension), wide(dimension), 0, 0
    if dimension < 2:
        return 1.0
    for _ in range(20):
        o, q = rng.standard_normal((2, 2000, dimension))
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        q -= (o * q).sum(axis=1, keepdims=True) * o
        q = limit * o + math.sqrt(1 - limit * limit) * q / np.linalg.norm(q, axis=1, keepdims=True)
        same, n = same + int((peaks(o[:, :m]) == peaks(q[:, :m])).sum()), n + 2000
    return same / n - 3 * math.sqrt(same * (n - same) / n) / n


def wide(dimension: int) -> int:
    """How many coordinates the largest is sought among."""
    return min(dimension, WIDE)


def peaks(rotated: np.ndarray) -> np.ndarray:
    """Per row twice the place of the coordinate largest in size, plus 1 if it is positive."""
    at = np.abs(rotated).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(rotated, at[..., None], axis=-1)[..., 0] > 0)


@functools.lru_cache(maxsize=64)
def bands_for(rows: int, dimension: int, limit: float = LIMIT, missed: float = MISSED) -> tuple[int, int, int]:
    """(largest coordinates in a band, signs in a band, number of bands): the fewest bands with codes enough."""
    bits = math.log2(max(rows, 2)) + 3
    peak, sign, best = agreement(dimension, limit), 1 - math.acos(limit) / math.pi, None
    for k in range(math.ceil(bits / math.log2(2 * wide(dimension))) + 1):
        signs = max(0, math.ceil(bits - k * math.log2(2 * wide(dimension))))
        both = peak**k * sign**signs
        plan = (k, signs, 1 if both >= 1 else math.ceil(math.log(missed) / math.log1p(-both)))
        best = plan if best is None or plan[2] < best[2] else best
    return best


@functools.lru_cache(maxsize=8)
def rotations(dimension: int, count: int) -> np.ndarray:
    """`count` random rotations, one above the other."""
    r = np.random.default_rng(dimension)
    return np.concatenate([np.linalg.qr(r.standard_normal((dimension, dimension)))[0] for _ in range(count)])


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of serialized vectors of one length."""
    v = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and all(map(math.isfinite, vector)) and any(vector)


def band_names(units: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """The bucket of each vector in each band as 32-bit numbers, from the rotations after the first."""
    (k, signs, bands), (n, d) = plan, units.shape
    m = wide(d)
    rows = k * m + signs
    turn = rotations(d, 1 + -(-rows * bands // d))[d:d + rows * bands]
    out = np.empty((n, bands), dtype=np.uint32)
    weights = np.uint64(1) << np.arange(signs, dtype=np.uint64)
    for band in range(bands):
        y = units @ turn[band * rows:(band + 1) * rows].T
        name = ((y[:, k * m:] > 0) * weights).sum(axis=1, dtype=np.uint64)
        for code in peaks(y[:, :k * m].reshape(n, k, m)).T if k else ():
            name = name * np.uint64(2 * m) + code.astype(np.uint64)
        name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = name >> np.uint64(32)
    return out


def number_kind(rows: DataFrame) -> str:
    return "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"


def classes(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id and class (null for vectors that link with nothing) of every row, with the serialized vector."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            raw = [np.asarray(v, dtype=kind).tobytes() if usable(v) else None for v in batch.column("embedding").to_pylist()]
            names = [None if r is None else xxhash.xxh3_64_intdigest(units_of([r], kind).tobytes()) - (1 << 63) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "cid", "vector"])

    return map_arrow(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, cid long, vector binary")


def by_length(raw: list[bytes]):
    for size in {len(x) for x in raw}:
        yield np.array([i for i, x in enumerate(raw) if len(x) == size])


def encode(found: DataFrame, rows: int, kind: str, limit: float, missed: float) -> DataFrame:
    """Of every class: signs, factor, and the name of its bucket in each band."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = batch.column("vector").to_pylist()
            signs, factors, keys = [None] * len(raw), np.zeros(len(raw)), [None] * len(raw)
            for at in by_length(raw):
                u = units_of([raw[i] for i in at], kind)
                d = u.shape[1]
                turned = u @ rotations(d, 1).T
                code, factors[at], names = np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(d), band_names(u, bands_for(rows, d, limit, missed)).view(np.int32)
                for k, i in enumerate(at.tolist()):
                    signs[i], keys[i] = code[k].tobytes(), names[k]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("copies"), batch.column("vector"), pa.array(signs, pa.binary()), pa.array(factors, pa.float64()), pa.array(keys, pa.list_(pa.int32()))], names=["cid", "copies", "vector", "signs", "factor", "keys"])

    return map_arrow(found, run, "cid long, copies long, vector binary, signs binary, factor double, keys array<int>")


class Vectors:
    """Vectors of one length in a task: unit vectors, codes with their factors, buckets by band."""

    def __init__(self, raw: list[bytes], kind: str, signs: list[bytes], factors: np.ndarray, keys: np.ndarray | None = None):
        self.units = units_of(raw, kind)
        d = self.d = self.units.shape[1]
        self.turned = self.units @ rotations(d, 1).T
        self.codes = np.unpackbits(np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(len(raw), -1), axis=1, count=d) * 2.0 - 1.0
        self.scale = 1 / (factors * math.sqrt(d))
        self.bound = ERROR * np.sqrt((1 - factors**2).clip(0) / (factors**2 * max(d - 1, 1)))
        self.keys = keys

    def hopeful(self, i: np.ndarray, j: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs those whose upper confidence bound reaches the limit."""
        kept = np.concatenate([np.einsum("ij,ij->i", self.codes[i[a:a + 50_000]], self.turned[j[a:a + 50_000]]) for a in range(0, len(i), 50_000)]) * self.scale[i] + self.bound[i] >= limit
        return i[kept], j[kept]

    def hopeful_across(self, left: np.ndarray, right: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for all pairs of a member of `left` with one of `right`."""
        estimate = self.codes[left] @ self.turned[right].T * self.scale[left, None] + self.bound[left, None]
        i, j = np.nonzero(estimate >= limit)
        return left[i], right[j]

    def first_met(self, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which pairs haven't met in a band before theirs."""
        out = np.ones(len(i), dtype=bool)
        for a in range(0, len(i), 50_000):
            x, y, b = i[a:a + 50_000], j[a:a + 50_000], band[a:a + 50_000]
            upto = int(b.max(initial=0))
            out[a:a + 50_000] = ~((self.keys[x, :upto] == self.keys[y, :upto]) & (np.arange(upto) < b[:, None])).any(axis=1)
        return out

    def linked(self, i: np.ndarray, j: np.ndarray, limit: float) -> np.ndarray:
        """Which pairs reach the limit, in double precision."""
        return np.concatenate([np.einsum("ij,ij->i", self.units[i[a:a + 50_000]], self.units[j[a:a + 50_000]]) for a in range(0, len(i), 50_000)] or [np.zeros(0)]) >= limit


def pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside runs of rows that begin at `start`."""
    i, j = [], []
    for n in np.unique(size).tolist():
        a, b = np.triu_indices(n, 1)
        at = start[size == n][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, dtype=np.int64),) * 2


def close_pairs(v: Vectors, groups: list[tuple[int, int, int | None]], band: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors inside groups (start, stop, border); with a border only across it, else each pair once."""
    few = np.array([(a, b - a) for a, b, border in groups if border is None and b - a <= FEW], dtype=np.int64).reshape(-1, 2)
    found = []
    for a in range(0, len(few), 2000):
        i, j = pairs_within(few[a:a + 2000, 0], few[a:a + 2000, 1])
        if len(i):
            found.append(v.hopeful(i, j, limit))
    for a, b, border in groups:
        if border is not None or b - a > FEW:
            left, right = np.arange(a, b if border is None else a + border), np.arange(a if border is None else a + border, b)
            i, j = v.hopeful_across(left, right, limit)
            found.append((i, j) if border is not None else (i[i < j], j[i < j]))
    out = []
    for i, j in found:
        fresh = v.first_met(i, j, band[i])
        i, j = i[fresh], j[fresh]
        exact = v.linked(i, j, limit)
        out.append((i[exact], j[exact]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2


def links_in_bands(coded: DataFrame, kind: str, limit: float) -> DataFrame:
    """(cid, other, n): per band and class the number of linked vectors of other classes; other is a spanning edge or null."""
    n = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    light = coded.select("cid", F.octet_length("vector").alias("bytes"), F.posexplode("keys").alias("band", "bucket"))
    light = light.select("cid", "band", F.xxhash64("bytes", "band", "bucket").alias("bucket"))
    sizes = light.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    entries = light.join(sizes, "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    entries = entries.withColumn("own", F.pmod(F.xxhash64("cid", "band"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    entries = entries.select("cid", "band", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("inside"))
    full = entries.join(coded, "cid").repartition(n, "pair").sortWithinPartitions("pair", "second")

    def run(batches):
        import pyarrow as pa

        for batch, groups in sorted_groups(batches, "pair"):
            cid, band, copies, factor = (batch.column(c).to_numpy() for c in ("cid", "band", "copies", "factor"))
            second, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("second", "inside"))
            raw, signs = batch.column("vector").to_pylist(), batch.column("signs").to_pylist()
            number = np.repeat(np.arange(len(groups)), [stop - start for start, stop in groups])
            a, b, count = [], [], []
            for at in by_length(raw):
                cuts = np.flatnonzero(np.diff(number[at])) + 1
                runs = []
                for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                    border = None if inside[at[start]] else int(np.searchsorted(second[at[start:stop]], True))
                    if stop - start > 1 and (border is None or 0 < border < stop - start):
                        runs.append((start, stop, border))
                if not runs:
                    continue
                keys = batch.column("keys").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                v = Vectors([raw[k] for k in at], kind, [signs[k] for k in at], factor[at], keys)
                i, j = close_pairs(v, runs, band[at], limit)
                linked = np.bincount(i, weights=copies[at[j]], minlength=len(at)) + np.bincount(j, weights=copies[at[i]], minlength=len(at))
                some = np.flatnonzero(linked)
                a += cid[at[some]].tolist()
                b += [None] * len(some)
                count += linked[some].astype(np.int64).tolist()
                parts = Parts(len(at))
                for s in range(0, len(i), 1000):
                    x, y = i[s:s + 1000], j[s:s + 1000]
                    for k in np.flatnonzero(parts.of[x] != parts.of[y]).tolist():
                        if parts.join(int(x[k]), int(y[k])):
                            a.append(int(cid[at[x[k]]]))
                            b.append(int(cid[at[y[k]]]))
                            count.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int64())], names=["cid", "other", "n"])

    return map_arrow(full, run, "cid long, other long, n long")


@tidy
def components(vectors: DataFrame, limit: float = LIMIT, missed: float = MISSED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding)."""
    kind = number_kind(vectors)
    rows = materialize(classes(vectors, kind), "vectors")
    found = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"))
    found = materialize(found, "vector-classes")
    coded = materialize(encode(found.select("cid", "copies", "vector"), found.count(), kind, limit, missed), "codes")
    links = materialize(links_in_bands(coded, kind, limit), "vector-links")
    release(coded)
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = connected_components(links.where(F.col("other").isNotNull()).select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "cid", "label": "component"})
    named = found.select("cid", "copies", "first").join(counts, "cid", "left").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "component-ids")  # apart, so that the join can split a large component
    named = named.join(smallest, "component").select("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
