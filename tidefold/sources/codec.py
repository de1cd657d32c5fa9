"""The ledger's binary formats: record payloads, checksummed frames, segments and snapshots.

All integers are little-endian.  Strings and bytes carry a u32 length; times are i64 nanoseconds,
0 for none; flags are one byte, true only for 1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tidefold.functions.checksum import crc32c
from tidefold.functions.ids import ALPHABET
from tidefold.schema import RECORD_TYPES, STATES

# Fixed values of the file formats.
SEGMENT_MAGIC, SNAPSHOT_MAGIC, SNAPSHOT_END = b"KMBW", b"KMBS", b"KMSE"
VERSION = 1
SEGMENT_HEADER = 16  # magic, u32 version, u64 reserved
FRAME = "<IIQBB"  # u32 length behind it, u32 crc32c of all from the lsn on, u64 lsn, u8 type, u8 flag
FRAME_BYTES = 18

#: Fields of each record type in their order; "job" stands for all fields of JOB_FIELDS.
JOB_FIELDS = (
    ("job_id", "id"), ("type", "text"), ("queue", "text"), ("payload", "bytes"), ("priority", "b"), ("state", "state"), ("attempt", "H"), ("max_attempts", "H"),
    ("run_at_ns", "time"), ("lease_expiry_ns", "time"), ("lease_token", "Q"), ("worker_id", "text"), ("cancel_req", "flag"), ("last_error", "text"), ("idem_key", "text"),
    ("created_at_ns", "time"), ("updated_at_ns", "time"),
)
RECORD_FIELDS = {
    "submit": JOB_FIELDS,
    "lease": (("job_id", "id"), ("worker_id", "text"), ("lease_expiry_ns", "time"), ("lease_token", "Q"), ("attempt", "H")),
    "complete": (("job_id", "id"), ("success", "flag"), ("error", "text")),
    "retry": (("job_id", "id"), ("run_at_ns", "time"), ("error", "text")),
    "dead": (("job_id", "id"), ("error", "text")),
    "cancel": (("job_id", "id"),),
    "expire": (("job_id", "id"), ("lease_token", "Q")),
}
TYPE_CODES = {v: k for k, v in RECORD_TYPES.items()}
STATE_CODES = {v: k for k, v in STATES.items()}
NULLABLE_TEXT = frozenset(("worker_id", "idem_key"))


class Corrupt(ValueError):
    """Bytes that aren't what they should be."""


def id_bytes(text: str) -> bytes:
    value = 0
    for c in text:
        value = value << 5 | ALPHABET.index(c)
    return value.to_bytes(16, "big")


def id_text(raw: bytes) -> str:
    value = int.from_bytes(raw, "big")
    return "".join(ALPHABET[value >> 5 * k & 31] for k in range(25, -1, -1))


def encode_fields(values: dict, fields) -> bytes:
    out = []
    for name, kind in fields:
        v = values.get(name)
        if kind == "id":
            out.append(id_bytes(v))
        elif kind in ("text", "bytes"):
            raw = v.encode() if isinstance(v, str) else bytes(v or b"")
            out.append(struct.pack("<I", len(raw)) + raw)
        elif kind == "time":
            out.append(struct.pack("<q", v or 0))
        elif kind == "flag":
            out.append(b"\x01" if v else b"\x00")
        elif kind == "state":
            out.append(bytes([STATE_CODES[v]]))
        else:
            out.append(struct.pack("<" + kind, v or 0))
    return b"".join(out)


def decode_fields(raw: bytes, fields, optional: int = 0) -> dict:
    """Values by name; the last `optional` fields may be missing."""
    out, at = {}, 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise Corrupt("record ends early")
        at += n
        return raw[at - n:at]

    for i, (name, kind) in enumerate(fields):
        if at == len(raw) and i >= len(fields) - optional:
            out[name] = None
        elif kind == "id":
            out[name] = id_text(take(16))
        elif kind in ("text", "bytes"):
            value = take(struct.unpack("<I", take(4))[0])
            out[name] = (value.decode(errors="replace") if value or name not in NULLABLE_TEXT else None) if kind == "text" else value or None
        elif kind == "time":
            out[name] = struct.unpack("<q", take(8))[0] or None
        elif kind == "flag":
            out[name] = take(1) == b"\x01"
        elif kind == "state":
            code = take(1)[0]
            if code not in STATES:
                raise Corrupt(f"no state {code}")
            out[name] = STATES[code]
        else:
            out[name] = struct.unpack("<" + kind, take(struct.calcsize(kind)))[0]
    return out


def encode_record(record: dict) -> bytes:
    kind = record["type"]
    if kind not in RECORD_FIELDS:
        raise Corrupt(f"no record type {kind}")
    return encode_fields(record["job"] if kind == "submit" else record, RECORD_FIELDS[kind])


def decode_record(kind: str, payload: bytes) -> dict:
    """A record's fields; those its type hasn't are absent."""
    values = decode_fields(payload, RECORD_FIELDS[kind], optional=1 if kind == "expire" else 0)
    return {"type": kind, "job_id": values["job_id"], "job": values} if kind == "submit" else {"type": kind, **values}


def encode_frame(record: dict) -> bytes:
    payload = encode_record(record)
    covered = struct.pack("<QBB", record["lsn"], TYPE_CODES[record["type"]], record.get("flag") or 0) + payload
    return struct.pack("<II", len(covered) + 4, crc32c(covered)) + covered


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, int, str, int, bytes]]:
    """(end, lsn, type, flag, payload) of frames from an offset on; raises Corrupt at the first bad one."""
    while at < len(data):
        if at + FRAME_BYTES > len(data):
            raise Corrupt(f"frame at {at} ends early")
        length, crc, lsn, kind, flag = struct.unpack_from(FRAME, data, at)
        end = at + 4 + length
        if length < FRAME_BYTES - 4 or end > len(data):
            raise Corrupt(f"frame at {at} ends early")
        if crc32c(data[at + 8:end]) != crc:
            raise Corrupt(f"frame at {at} fails its checksum")
        if kind not in RECORD_TYPES:
            raise Corrupt(f"no record type {kind}")
        yield end, lsn, RECORD_TYPES[kind], flag, data[at + FRAME_BYTES:end]
        at = end


def segment_header() -> bytes:
    return SEGMENT_MAGIC + struct.pack("<IQ", VERSION, 0)


def read_segment(data: bytes, last: bool) -> tuple[list[dict], int]:
    """(records, valid bytes) of a segment.  A bad tail ends the last segment and is fatal in any other; nothing is written."""
    if data[:4] != SEGMENT_MAGIC or len(data) < SEGMENT_HEADER or struct.unpack_from("<I", data, 4)[0] != VERSION:
        raise Corrupt("no segment header")
    out, valid = [], SEGMENT_HEADER
    try:
        for end, lsn, kind, flag, payload in frames(data, SEGMENT_HEADER):
            out.append({"lsn": lsn, "flag": flag, **decode_record(kind, payload)})
            valid = end
    except Corrupt:
        if not last:
            raise
    return out, valid


def segment_name(first_lsn: int) -> str:
    return f"{first_lsn:020d}.wal"


def segment_lsn(name: str) -> int | None:
    return int(name[:-4]) if len(name) == 24 and name.endswith(".wal") and name[:-4].isascii() and name[:-4].isdigit() else None


def encode_snapshot(jobs: list[dict], lsn: int) -> bytes:
    parts = [SNAPSHOT_MAGIC, struct.pack("<II", VERSION, len(jobs))]
    for job in jobs:
        raw = encode_fields(job, JOB_FIELDS)
        parts += [struct.pack("<I", len(raw)), raw]
    body = b"".join([*parts, struct.pack("<Q", lsn)])
    return body + struct.pack("<I", crc32c(body)) + SNAPSHOT_END


def decode_snapshot(data: bytes) -> tuple[list[dict], int]:
    """(jobs, lsn) of a snapshot; raises Corrupt."""
    jobs, lsn = snapshot_jobs(data)
    return list(jobs), lsn


def snapshot_jobs(data: bytes) -> tuple[Iterator[dict], int]:
    """The same with jobs decoded as they are asked for; what the checksum and the lengths can tell is checked before."""
    if len(data) < 28 or data[:4] != SNAPSHOT_MAGIC or data[-4:] != SNAPSHOT_END:
        raise Corrupt("no snapshot")
    version, count = struct.unpack_from("<II", data, 4)
    if version != VERSION or crc32c(data[:-8]) != struct.unpack_from("<I", data, len(data) - 8)[0]:
        raise Corrupt("snapshot fails its checksum or version")
    spans, at = [], 12
    for _ in range(count):
        if at + 20 > len(data):
            raise Corrupt("snapshot has another length than its count says")
        n = struct.unpack_from("<I", data, at)[0]
        spans.append((at + 4, at + 4 + n))
        at += 4 + n
    if at + 16 != len(data):
        raise Corrupt("snapshot has another length than its count says")
    return (decode_fields(data[a:b], JOB_FIELDS) for a, b in spans), struct.unpack_from("<Q", data, at)[0]


def snapshot_name(lsn: int) -> str:
    return f"{lsn:020d}.snap"


def snapshot_lsn(name: str) -> int | None:
    return int(name[:-5]) if len(name) == 25 and name.endswith(".snap") and name[:-5].isascii() and name[:-5].isdigit() else None
