from pyspark.sql import functions as F

from tidefold.functions import ids
from tidefold.sources.codec import id_bytes, id_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_encode_and_decode_agree_with_plain_arithmetic(spark):
    raws = [bytes(16), bytes([255]) * 16, bytes(range(16)), b"\x01" + bytes(15)]
    rows = spark.createDataFrame([(r,) for r in raws], "b binary").select("b", ids.encode(F.col("b")).alias("t"), ids.decode(ids.encode(F.col("b"))).alias("back")).collect()
    for r in rows:
        assert r.t == id_text(bytes(r.b)) and len(r.t) == 26
        assert bytes(r.back) == bytes(r.b) == id_bytes(r.t)


def test_text_sorts_like_bytes():
    raws = [bytes([a, b]) + bytes(14) for a in (0, 1, 127, 255) for b in (0, 5, 200)]
    assert sorted(raws) == [id_bytes(t) for t in sorted(map(id_text, raws))]


def test_invalid_texts(spark):
    texts = ["", "123", "0" * 28, "0" * 25, "8" + "0" * 25, "0" * 25 + "U", None]
    assert all(one(spark, ids.normalize(F.lit(t))) is None for t in texts)


def test_look_alikes_and_case(spark):
    a, b = "01J00000000000000000000001", "o1joooooooooooooooooooooo1"
    assert one(spark, ids.normalize(F.lit(b))) == a
    assert one(spark, ids.decode(F.lit(a))) == one(spark, ids.decode(F.lit(b)))


def test_time_in_an_id(spark):
    made = ids.from_hash(F.lit(1_700_000_000_123).cast("long"), F.lit("x"))
    assert one(spark, ids.time_ms(made)) == 1_700_000_000_123
    assert one(spark, ids.build(F.lit(-1).cast("long"), F.unhex(F.lit("00" * 10)))) is None
    assert one(spark, ids.build(F.lit(1 << 48), F.unhex(F.lit("00" * 10)))) is None
    assert one(spark, ids.is_zero(F.unhex(F.lit("00" * 16))))
