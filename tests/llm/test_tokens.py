"""op1, op5 and op9 against the libraries, on texts made to be awkward."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidefold.llm import bpe, packing, token_chunks, token_store

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, length string, roots int"  # with names that the operators use themselves


def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "  a  b ", "\x85 x\x1c", "a" * 4000, "abab" * 300, "日本語 🤗🤗 é", "don't they'LL \n\n 12345", "<|endoftext|> <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>", "日本語" * 200, "x\n y", "the the the"]
    letters = "abcdef'  \n\t.,!é漢🤗0123\xa0 the ing er on"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(150)] + ["tie", "tie"]


def rows(spark, some=None):
    some = texts() if some is None else some
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(some)], SCHEMA)


def tiktoken_ids(some):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t or "") for t in some]


def library_ids(some):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch([x or "" for x in some], add_special_tokens=False)]


def test_codec_equals_the_library(spark):
    found = {r.doc_id: r for r in bpe.encode_decode(rows(spark), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, (t, ids) in enumerate(zip(texts(), tiktoken_ids(texts()), strict=True)):
        r = found[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(rows(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_the_word_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    codec, cache, rng = bpe.load(RANKS, public_tokenizers.PATTERN), bpe.Words(), random.Random(4)
    for k in range(30):
        some = ["x" * 5000 + str(k), *[f"w{rng.randrange(10**9)} " + "z" * rng.randrange(300) for _ in range(20)]]
        assert [np.frombuffer(raw, "<u4").tolist() for raw, _ in codec.encode_block(some, cache)] == tiktoken_ids(some)
        assert len(cache) * bpe.ENTRY_BYTES <= 50_000 and not any(len(w) > bpe.LONGEST for w in cache)


def test_merges_out_of_order_are_redone_word_by_word():
    """A rank table where a merge makes a pair that ranks before the merge itself."""
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {b"cd": 300, b"bc": 400, b"abc": 450, b"abcd": 500, b"ab": 600, b"aa": 601, b"aaaa": 602, b"ba": 599, b"aba": 598}
    codec = bpe.MergeReplay(ranks, public_tokenizers.PATTERN)
    rng = random.Random(0)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    for w, ids in zip(words, codec.merge_all(words), strict=True):
        assert ids == ([ranks[w]] if w in ranks else codec.merge_one(w))
        assert codec.decode(ids) == w


def test_chunks_equal_the_library():
    some = [t or "" for t in texts()]
    found = token_chunks.ChunkEncoder(JSON).encode(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == library_ids(some)


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(token_chunks, "CACHE_BYTES", 20_000)
    encoder = token_chunks.ChunkEncoder(JSON)
    rng, most = random.Random(1), 0
    for k in range(60):
        some = ["".join(rng.choice("日本語漢字") for _ in range(300)) for _ in range(20)] + [f"w{k}{i} v{i * k}" for i in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == library_ids(some)
        most = max(most, len(encoder.at_start) + len(encoder.after_space) + len(encoder.older))
        assert not any(len(w) > token_chunks.LONGEST for w in [*encoder.at_start, *encoder.after_space, *encoder.older])
    assert most <= 20_000 // token_chunks.ENTRY_BYTES + 40


def test_dictionary_draws_on_whole_documents(spark):
    """Pieces beyond the first 256 KiB count: the tail of a long document is known to the dictionary."""
    rng = np.random.default_rng(2)
    tail = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    ids = b"".join(rng.integers(0, 256, 1096, dtype=np.uint8).tobytes() + (tail if k > 70 else rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()) for k in range(140))
    made = token_store.train_dictionary(spark.createDataFrame([(1, ids)], "doc_id long, ids binary"))
    assert any(tail[i:i + 48] in made for i in range(0, 2900, 16))
    rows = [(1, ids), (1, ids[::-1]), (None, ids[5:]), (None, ids[:-5]), (2, b"")]
    assert len({token_store.train_dictionary(spark.createDataFrame(some, "doc_id long, ids binary"), pieces=300) for some in (rows, rows[::-1])}) == 1


def test_samples_are_the_same_whatever_the_order_and_the_keys(spark):
    from tidefold.llm.common import hash_sample

    rows = [(None, f"n{i}") for i in range(40)] + [(5, f"t{i}") for i in range(30)] + [(5, "same")] * 20 + [(i, "u") for i in range(100, 130)]
    for most in (0, 1, 25, 60, 1000):
        found = [sorted(map(str, hash_sample(spark.createDataFrame(some, "k long, t string").repartition(n), "k", most).collect())) for some, n in ((rows, 3), (rows[::-1], 5))]
        assert found[0] == found[1] and len(found[0]) == min(most, len(rows))


def test_store_reads_back_what_it_wrote(spark, tmp_path):
    some = texts()
    folder = f"file://{tmp_path}/t"
    manifest = token_store.write(rows(spark, some).orderBy("text"), JSON, folder, partitions=3)
    found = token_store.read(manifest, folder, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for i, (r, ids) in enumerate(zip(found, library_ids(some), strict=True)):
        ids = [*ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = manifest.orderBy("part").first()
    dictionary = (tmp_path / "t" / "dictionary.zstd").read_bytes()
    store = token_store.StoreFile(one.path, dictionary)
    assert [np.frombuffer(store.ids_at(k), "<u4").tolist() for k in store.find(5)] == [[*library_ids(some)[5], 0]]
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.StoreFile(one.path, b"other")


def test_store_of_repeated_null_and_no_rows(spark):
    twice = spark.createDataFrame([(7, "b"), (7, "a"), (None, "n"), (7, "a")], "doc_id long, text string")
    found = token_store.round_trip(twice, JSON).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 7, 7, 7] and [r.start for r in found] == [0, 2, 4, 6]
    assert token_store.round_trip(twice.where("false"), JSON).count() == 0
    least = spark.createDataFrame([(-(1 << 63), "least"), (None, "n"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in token_store.round_trip(least, JSON).orderBy("start").collect()] == [None, None, -(1 << 63)]


def test_whole_pieces_and_repeated_rows_fill_no_shard(spark):
    some = spark.createDataFrame([(1, "word " * 5000)] * 60 + [(None, "some text")] * 300 + [(2, None)] * 300, "doc_id long, text string")
    cut = packing.pieces(some, JSON)
    assert cut.where("length = 1024").count() > 200
    found = packing.pack(some, JSON, shard_pieces=50)
    shards = found.where("sequence_id >= 0").selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()
    assert len(shards) > 8 and max(r["count"] for r in shards) < 120
    assert found.where("length = 1024").select("sequence_id").distinct().count() == cut.where("length = 1024").count()
    assert found.count() == cut.count() and found.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_cuts():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_rule_of_placement():
    """Against the rule written out: the sum over gaps of squared counts after each possible place."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 200)
    sequence, offset = packing.place(lengths, 20)
    gaps: dict[int, int] = {}

    def total(g):
        counts: dict[int, int] = {}
        for x in g.values():
            if x:
                counts[x] = counts.get(x, 0) + 1
        return sum(c * c for c in counts.values())

    for size, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        fits = {k: total({**gaps, k: g - size}) for k, g in gaps.items() if g >= size}
        if fits:
            assert s in fits and fits[s] == min(fits.values())
        else:
            assert s not in gaps
        assert o == 20 - gaps.get(s, 20)
        gaps[s] = gaps.get(s, 20) - size


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    some = texts() + [" ".join("word" for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    found = packing.pack(rows(spark, some), JSON).toPandas()
    for i, ids in enumerate(library_ids(some)):
        ids, at = [*ids, 2], 0
        for r in found[found.doc_id == i].sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 1024
    least = -(-found.length.sum() // 1024)
    assert found.sequence_id.nunique() <= least + 2
    assert packing.pack(rows(spark, []), JSON).count() == 0
    assert packing.pack(rows(spark, some), JSON, shard_pieces=40).select("sequence_id").distinct().count() >= least
