"""Byte-level BPE by corpus-level merge replay.

All distinct pre-tokens of a block of documents are laid out as one symbol array with
neighbour links.  An inverted index leads from each mergeable token pair (named by the rank
of the token it makes) to its positions.  Merges are replayed in rank order over the whole
block at once; a merge touches its own positions and their two neighbours only.  Finished
words stay in a cache of the Python worker, bounded by bytes, so frequent words are merged once.

Defined results: null text is the empty text (0 tokens, hashes of the empty string); no text
is cut, however long; repeated rows are encoded each on its own; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import map_arrow, row_slices, text_or_empty

NONE = np.int64(1 << 40)
CACHE_BYTES = 200 << 20
ENTRY_BYTES = 400  # of a word in the cache besides its characters and ids
LONGEST = 256  # characters; longer words aren't kept


class Words(dict):
    """Finished words, by what they hold in bytes."""

    held = 0

    def settle(self, new: list[str]) -> None:
        """After `new` words have been used: long ones go, and all when they hold too much."""
        for w in new:
            if len(w) > LONGEST:
                del self[w]
            else:
                self.held += ENTRY_BYTES + 4 * len(w)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class MergeReplay:
    """Encoder and decoder over a rank table {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None and (right := get(token[cut:])) is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(-1))
        self.pair_made = np.append(np.array(made, dtype=np.int64)[order], NONE)

    def made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE if it doesn't."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], NONE)

    def merge_one(self, word: bytes) -> list[int]:
        """One word by itself, lowest rank and leftmost first."""
        symbols = [self.ranks[word[i:i + 1]] for i in range(len(word))]
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            symbols[i:i + 2] = [rank]
        return [int(s) for s in symbols]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word."""
        whole = [self.ranks.get(w) for w in words]
        todo = [i for i, r in enumerate(whole) if r is None and words[i]]
        out: list[list[int]] = [[r] if r is not None else [] for r in whole]
        if not todo:
            return out
        lengths = np.array([len(words[i]) for i in todo], dtype=np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        symbol = self.byte_ids[np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)]
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[ends - 1] = -1
        before[ends - lengths] = -1
        alive = np.ones(n, dtype=bool)
        made = np.full(n, NONE)
        inner = np.flatnonzero(follow >= 0)
        made[inner] = self.made_by(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = made[positions]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            stop = int(np.searchsorted(ranks, NONE))
            if not stop:
                return
            starts = np.flatnonzero(np.r_[True, ranks[1:stop] != ranks[:stop - 1]])
            for a, b, r in zip(starts.tolist(), [*starts[1:].tolist(), stop], ranks[starts].tolist(), strict=True):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(heap, r)

        enter(inner)
        odd: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[made[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                if len(lists) > 1:
                    at = np.unique(at)
                overlap = follow[at[:-1]] == at[1:]
                if overlap.any():  # runs such as aaaa: every second position, from the left
                    k = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.r_[True, ~overlap], k, 0))
                    at = at[(k - start) % 2 == 0]
            gone = follow[at]
            after = follow[gone]
            symbol[at] = rank
            follow[at] = after
            alive[gone] = False
            made[gone] = NONE
            made[at] = NONE
            has = after >= 0
            before[after[has]] = at[has]
            left = before[at]
            touched = np.concatenate((at[has], left[left >= 0]))
            if len(touched):
                if len(at) > 1:
                    touched = np.unique(touched)
                new = self.made_by(symbol[touched], symbol[follow[touched]])
                made[touched] = new
                if (low := new < rank).any():  # a merge that should have come in between: such words go one by one
                    odd.update(np.searchsorted(ends, touched[low], side="right").tolist())
                enter(touched[new < NONE])
        kept = np.flatnonzero(alive)
        ids = symbol[kept].tolist()
        stops = np.searchsorted(kept, ends).tolist()
        a = 0
        for i, b in zip(todo, stops, strict=True):
            out[i] = ids[a:b]
            a = b
        for k in odd:
            out[todo[k]] = self.merge_one(words[todo[k]])
        return out

    def encode_block(self, texts: list[str], cache: Words) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and as decimals joined by a space."""
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(cache))
        for word, ids in zip(new, self.merge_all([w.encode() for w in new]), strict=True):
            cache[word] = (np.array(ids, dtype="<u4").tobytes(), " ".join(map(str, ids)))
        out = []
        for words in split:
            found = [cache[w] for w in words]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        cache.settle(new)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> MergeReplay:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return MergeReplay(ranks, pattern)


@functools.lru_cache(maxsize=2)
def word_cache(path: str, pattern: str) -> Words:
    """It lives as long as the Python worker."""
    return Words()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode `text` of every row, decode it again; one narrow pass, no shuffle.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded bytes are the
    text's), with with_ids also ids (array of int).  `ranks_path` must exist on every executor,
    as an installed tokenizer package does.
    """

    def run(batches):
        import pyarrow as pa

        codec = load(ranks_path, pattern)
        cache = word_cache(ranks_path, pattern)
        for whole in batches:
            for batch in row_slices(whole):
                texts = batch.column("text").to_pylist()
                n, ids_hash, text_hash, same, all_ids = [], [], [], [], []
                for text, (raw, decimals) in zip(texts, codec.encode_block(texts, cache), strict=True):
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    decoded = codec.decode(ids)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(decimals.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == text.encode())
                    if with_ids:
                        all_ids.append(ids)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, run, schema + (", ids array<int>" if with_ids else ""))
