"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once per worker.

A byte-level BPE tokenizer splits text before it merges, and a space that a non-space follows
always starts a new split.  So a text is cut at such spaces, every distinct chunk is encoded by
the library once, and a document's ids are its chunks' ids in a row.  New chunks are encoded many
at a time, in one text: a token that begins with a space then begins a chunk.  Texts where a space
is followed by white space or by nothing go to the library whole, and so do texts that hold the
string of a special token, which the library takes for that token.

What a worker keeps is bounded by bytes: when half of them are used, what was kept before the half is
forgotten, but for chunks that have come up again since.  Chunks above `LONGEST` characters (texts without
spaces) aren't kept at all.
"""

from __future__ import annotations

import functools
import os
from array import array
from itertools import chain

import numpy as np

CACHE_BYTES = 200 << 20
ENTRY_BYTES = 220  # of an entry besides its characters and ids
LONGEST = 256
TOGETHER = 100


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for texts without their strings, where the search for them is spared
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # the library's sign for a space
        self.path, self.with_special = path, None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = [t for t in self.special if " " in t]
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what followed a space before the last half of the cache
        self.held = 0

    def _ids(self, texts: list[str]):
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _whole(self, text: str) -> bytes:
        """The ids of a text that holds the string of a special token."""
        if self.with_special is None:
            self.with_special = type(self.tokenizer).from_file(self.path)
            self.with_special.no_padding()
            self.with_special.no_truncation()
        return array("I", self.with_special.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks that follow a space into the cache."""
        blocks = [chunks[i:i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        joined = [" " + " ".join(b) for b in blocks]
        for block, text, raw in zip(blocks, joined, self._ids(joined), strict=True):
            starts = (np.flatnonzero(self.begins[np.frombuffer(raw, dtype="<u4")]) * 4).tolist()
            if len(starts) == len(block) and not any(t in text for t in self.spaced):
                self.after_space.update(zip(block, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))
            else:
                self.after_space.update(zip(block, self._ids([f" {w}" for w in block]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        plain = [w for w in split if w]
        first = list({w[0] for w in plain}.difference(self.at_start))
        self.at_start.update(zip(first, self._ids(first), strict=True))
        new = set(chain.from_iterable([w[1:] for w in plain])).difference(self.after_space)
        again = new.intersection(self.older)
        self.after_space.update(zip(again, map(self.older.__getitem__, again), strict=True))
        fresh = [w for w in new.difference(again) if w and not w[0].isspace()]
        self._learn(fresh)
        get = self.after_space.__getitem__
        out = []
        for text, words in zip(texts, split, strict=True):
            try:
                out.append(self.at_start[words[0]] + b"".join(map(get, words[1:])) if words else self._whole(text))
            except KeyError:
                out.append(next(self._ids([text])))
        for kept, entered in ((self.at_start, first), (self.after_space, [*again, *fresh])):
            sizes = list(map(len, entered))
            self.held += ENTRY_BYTES * len(sizes) + 3 * sum(sizes)
            if sizes and max(sizes) > LONGEST:
                for w in entered:
                    if len(w) > LONGEST:
                        del kept[w]
                        self.held -= ENTRY_BYTES + 3 * len(w)
        if self.held > CACHE_BYTES // 2:
            self.older, self.after_space, self.at_start, self.held = self.after_space, {}, {}, 0
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
