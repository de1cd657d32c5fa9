import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.functions.checksum import crc32c, crc32c_of, crc32c_of_slices
from tidefold.schema import RECORD
from tidefold.sources import codec, columnar, files, log, snapshots

ID = codec.id_text(bytes(range(16)))
JOB = {
    "job_id": ID, "type": "t", "queue": "default", "payload": b'{"index":1}', "priority": -5, "state": "leased", "attempt": 2, "max_attempts": 3, "run_at_ns": 5, "lease_expiry_ns": None,
    "lease_token": 7, "worker_id": "w", "cancel_req": True, "last_error": "", "idem_key": None, "created_at_ns": 1, "updated_at_ns": 2,
}
RECORDS = [
    {"type": "submit", "job_id": ID, "job": JOB}, {"type": "lease", "job_id": ID, "worker_id": "w", "lease_expiry_ns": 9, "lease_token": 1, "attempt": 1},
    {"type": "complete", "job_id": ID, "success": True, "error": ""}, {"type": "complete", "job_id": ID, "success": False, "error": "e"}, {"type": "retry", "job_id": ID, "run_at_ns": 3, "error": "x"},
    {"type": "dead", "job_id": ID, "error": "gone"}, {"type": "cancel", "job_id": ID}, {"type": "expire", "job_id": ID, "lease_token": 4},
]


def numbered(n, start=1):
    return [{"lsn": start + i, "flag": 0, **RECORDS[i % len(RECORDS)]} for i in range(n)]


def segment(records):
    return codec.segment_header() + b"".join(map(codec.encode_frame, records))


def test_known_checksum():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    assert crc32c(b"1234567890123456789") == crc32c(b"0123456789", crc32c(b"123456789"))


@pytest.mark.parametrize("record", RECORDS, ids=lambda r: r["type"])
def test_records_round_trip(record):
    assert codec.decode_record(record["type"], codec.encode_record(record)) == record


def test_truncated_records_are_refused():
    for r in RECORDS:
        raw = codec.encode_record(r)
        for cut in range(len(raw)):
            if r["type"] == "expire" and cut == 16:
                assert codec.decode_record("expire", raw[:16])["lease_token"] is None
                continue
            with pytest.raises(codec.Corrupt):
                codec.decode_record(r["type"], raw[:cut])


def test_random_cuts_leave_an_exact_prefix():
    records = numbered(20)
    data = segment(records)
    ends = [codec.SEGMENT_HEADER]
    for r in records:
        ends.append(ends[-1] + len(codec.encode_frame(r)))
    rng = random.Random(42)
    for _ in range(100):
        cut = rng.randint(codec.SEGMENT_HEADER, len(data))
        whole = sum(e <= cut for e in ends) - 1
        found, valid = codec.read_segment(data[:cut], True)
        assert found == records[:whole] and valid == ends[whole]
        if cut not in ends:
            with pytest.raises(codec.Corrupt):
                codec.read_segment(data[:cut], False)


def test_flipped_bytes_never_crash_the_reader():
    data = segment(numbered(5))
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(data)
        bad[rng.randrange(16, len(bad))] ^= rng.randrange(1, 256)
        assert len(codec.read_segment(bytes(bad), True)[0]) <= 5
    for _ in range(300):
        raw = codec.segment_header() + rng.randbytes(rng.randrange(0, 80))
        assert codec.read_segment(raw, True)[1] >= codec.SEGMENT_HEADER
    with pytest.raises(codec.Corrupt):
        codec.read_segment(b"XXXX" + data[4:], True)


def test_columns_make_the_same_bytes_and_records():
    rng = random.Random(3)
    rows = numbered(200)
    rows += [{"lsn": 300 + i, "flag": i % 3, "type": "submit", "job_id": ID, "job": {**JOB, "queue": "ü" * i, "payload": rng.randbytes(i) or None, "priority": i - 60, "last_error": "漢字"[: i % 3]}} for i in range(120)]
    batch = pa.RecordBatch.from_pylist(rows, schema=columnar.RECORD_TYPE)
    raw, ends = columnar.encode(batch)
    assert raw == b"".join(map(codec.encode_frame, rows)) and ends[-1] == len(raw)
    back, valid = columnar.read_segment(codec.segment_header() + raw, False)
    assert back.equals(batch) and valid == 16 + len(raw)
    part = batch.slice(50, 40)
    assert columnar.encode(part)[0] == b"".join(map(codec.encode_frame, rows[50:90]))
    assert columnar.encode(batch.slice(0, 0))[0] == b"" and columnar.read_segment(codec.segment_header(), True)[0].num_rows == 0


def test_columns_read_torn_and_damaged_segments_alike():
    rng = random.Random(11)
    data = segment(numbered(12))
    for k in range(400):
        bad = bytearray(data[:rng.randint(16, len(data))]) if k % 2 else bytearray(data)
        if k % 4 != 1 and len(bad) > 16:
            bad[rng.randrange(16, len(bad))] ^= rng.randrange(1, 256)
        bad = bytes(bad)
        records, valid = codec.read_segment(bad, True)
        batch, upto = columnar.read_segment(bad, True)
        assert batch.num_rows == len(records) and upto == valid
        for last in (False,):
            try:
                codec.read_segment(bad, last)
            except codec.Corrupt:
                with pytest.raises(codec.Corrupt):
                    columnar.read_segment(bad, last)
            else:
                assert columnar.read_segment(bad, last)[0].num_rows == len(records)


def test_a_whole_frame_with_a_broken_record_ends_the_newest_segment():
    good = numbered(3)
    broken = codec.struct.pack("<QBB", 9, 2, 0) + b"short"
    frame = codec.struct.pack("<II", len(broken) + 4, crc32c(broken)) + broken
    data = segment(good) + frame + b"".join(map(codec.encode_frame, numbered(1, 10)))
    batch, valid = columnar.read_segment(data, True)
    assert batch.num_rows == 3 and valid == len(segment(good)) == codec.read_segment(data, True)[1]
    with pytest.raises(codec.Corrupt):
        columnar.read_segment(data, False)


def test_checksums_of_slices_and_columns(spark):
    rng = random.Random(2)
    data = rng.randbytes(3000)
    starts, lengths = [rng.randrange(2500) for _ in range(200)], [rng.randrange(0, 90) for _ in range(200)]
    found = crc32c_of_slices(np.frombuffer(data, dtype=np.uint8), np.array(starts), np.array(lengths))
    assert found.tolist() == [crc32c(data[a:a + n]) for a, n in zip(starts, lengths, strict=True)]
    rows = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "x binary")
    assert [r.c for r in rows.select(crc32c_of(F.col("x")).alias("c")).collect()] == [0xE3069283, None, 0]


def test_file_names():
    assert codec.segment_name(7) == "00000000000000000007.wal" and codec.segment_lsn("00000000000000000007.wal") == 7
    assert codec.segment_lsn("7.wal") is None and codec.segment_lsn("0000000000000000000x.wal") is None
    assert codec.snapshot_lsn(codec.snapshot_name(12)) == 12


def test_snapshots_round_trip_and_fall_back(tmp_path, spark):
    folder = str(tmp_path)
    snapshots.save([JOB], folder, 50)
    snapshots.save([JOB, JOB], folder, 100)
    assert snapshots.load_newest(folder) == ([JOB, JOB], 100)
    assert snapshots.as_frame(spark, folder).count() == 2
    newest = tmp_path / codec.snapshot_name(100)
    raw = bytearray(newest.read_bytes())
    raw[20] ^= 1
    newest.write_bytes(bytes(raw))
    assert snapshots.load_newest(folder) == ([JOB], 50)
    snapshots.save([], folder, 150)
    assert snapshots.names(folder) == [codec.snapshot_name(150), codec.snapshot_name(100)]
    assert snapshots.load_newest(str(tmp_path / "none")) == ([], 0)


def test_log_source_reads_segments_and_skips_by_lsn(tmp_path, spark):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([tuple(r.get(n) if n != "job" else (tuple(JOB[k] for k in RECORD["job"].dataType.names) if r.get("job") else None) for n in RECORD.names) for r in numbered(25)], RECORD)
    written = log.write_segments(rows, folder, per_segment=10).collect()
    assert sorted(w.first_lsn for w in written) == [1, 11, 21] and log.next_lsn(folder) == 26
    frame = log.replay(spark, folder)
    assert [r.lsn for r in frame.orderBy("lsn").collect()] == list(range(1, 26))
    assert frame.where("type = 'submit'").first().job.queue == "default"
    assert frame.where("lsn >= 21").count() == 5
    assert log.replay(spark, folder, 20, 22).count() == 3
    reader = log.LogReader(folder, 12)
    assert [p.path[-24:] for p in reader.partitions()] == [codec.segment_name(11), codec.segment_name(21)]
    with open(f"{folder}/{codec.segment_name(21)}", "ab") as f:
        f.write(b"\x01\x02\x03\x04\x05")
    assert frame.count() == 25 and log.next_lsn(folder) == 26
    assert log.truncate(folder, 8) == [] and log.truncate(folder, 21) == [codec.segment_name(1), ] + [codec.segment_name(11)]
    assert files.listing(folder) == [codec.segment_name(21)]


def test_a_corrupt_sealed_segment_fails_the_read(tmp_path, spark):
    for start in (1, 6):
        files.write_bytes(f"{tmp_path}/{codec.segment_name(start)}", segment(numbered(5, start)))
    first = tmp_path / codec.segment_name(1)
    first.write_bytes(first.read_bytes()[:-3])
    with pytest.raises(Exception, match="ends early"):
        log.replay(spark, str(tmp_path)).count()
