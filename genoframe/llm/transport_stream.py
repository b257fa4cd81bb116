"""Operator 5, media columns: MPEG-2 transport streams (ISO/IEC 13818-1), written and parsed with numpy.

A stream holds a program association table, a program map table with one private-data stream, and one PES
packet for each ACCESS_BYTES of payload. PES packets carry a presentation timestamp; the first packet of
each carries a program clock reference and, at every RANDOM_EVERY-th unit, the random-access flag.
Parsing trusts only the bytes: it follows the tables' ids (with their CRC-32/MPEG), checks continuity
counters, reassembles PES packets and reports timestamps, random-access points and faults.

A null or empty text gives 64 zero bytes. Equal payloads give equal streams. Damaged streams never raise:
packets without a sync byte and continuity gaps are counted, tables that fail their check are passed over.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

PACKET, BODY = 188, 184
PROGRAM, PMT_PID, DATA_PID, PRIVATE = 1, 0x1000, 0x0100, 0x06
ACCESS_BYTES, RANDOM_EVERY, TICKS = 1 << 14, 8, 3600


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(table: int, extension: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def table_packet(pid: int, table: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + table).ljust(PACKET, b"\xff")


TABLES = table_packet(0, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def pts_bytes(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def read_pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def unit_packets(data: bytes, k: int, counter: int) -> np.ndarray:
    """Packets of one PES packet: full bodies, with clock and flags in the first and stuffing in the last."""
    pes = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + pts_bytes(k * TICKS % (1 << 33)) + data
    base = k * TICKS % (1 << 33)
    clock = bytes([7, 0x10 | (0x40 if k % RANDOM_EVERY == 0 else 0)]) + (base << 15 | 0x7E00).to_bytes(6, "big")
    n = 1 + max(0, -(-(len(pes) - (BODY - 8)) // BODY))
    out = np.zeros((n, PACKET), np.uint8)
    out[:, 0] = 0x47
    out[:, 1], out[:, 2] = DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    room = n * BODY - 8 - len(pes)  # stuffing in the last packet
    body = np.frombuffer(pes, np.uint8)
    if n == 1:
        clock = bytes([7 + room]) + clock[1:] + b"\xff" * room
        out[0, 4 : 4 + len(clock)] = np.frombuffer(clock, np.uint8)
        out[0, 4 + len(clock) :] = body
        return out
    out[0, 4:12], out[0, 12:] = np.frombuffer(clock, np.uint8), body[: BODY - 8]
    full = body[BODY - 8 : BODY - 8 + (n - 2) * BODY]
    out[1 : n - 1, 4:] = full.reshape(-1, BODY)
    if room:
        field = (bytes([room - 1]) + b"\0" + b"\xff" * (room - 2))[:room]
        out[-1, 3] |= 0x20
        out[-1, 4 : 4 + room] = np.frombuffer(field, np.uint8)
    out[-1, 4 + room :] = body[BODY - 8 + len(full) :]
    return out


def write_stream(payload: bytes) -> bytes:
    parts, counter = [], 0
    for k in range(-(-len(payload) // ACCESS_BYTES)):
        parts.append(unit_packets(payload[k * ACCESS_BYTES : (k + 1) * ACCESS_BYTES], k, counter))
        counter += len(parts[-1])
    return TABLES + b"".join(x.tobytes() for x in parts)


def sections(packets: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> list[bytes]:
    """Bodies of the sound sections of a table that start in packets of a program id."""
    found = []
    for p in np.flatnonzero((pid == wanted) & (packets[:, 1] & 0x40 > 0) & (packets[:, 3] & 0x10 > 0)):
        raw = packets[p].tobytes()
        at = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
        if at >= PACKET - 4 or (at := at + 1 + raw[at]) > PACKET - 12:
            continue
        size = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)
        whole = raw[at : at + size]
        if raw[at] == table and 12 <= size == len(whole) and crc_mpeg(whole) == 0:
            found.append(whole[8:-4])
    return found


def parse_stream(media: bytes) -> dict:
    """Payload of all elementary streams in order of their ids, timestamps, random-access points (packet numbers), faults."""
    n = len(media) // PACKET
    packets = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    sound = packets[:, 0] == 0x47
    lost = int((~sound).sum()) + (len(media) % PACKET > 0)
    packets = packets[sound]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    programs = [int.from_bytes(b[k + 2 : k + 4], "big") & 0x1FFF for b in sections(packets, pid, 0, 0) for k in range(0, len(b) - 3, 4) if b[k : k + 2] != b"\0\0"]
    streams: dict[int, int] = {}
    for p in dict.fromkeys(programs):
        for b in sections(packets, pid, p, 2):
            at = 4 + (int.from_bytes(b[2:4], "big") & 0xFFF)
            while at + 5 <= len(b):
                streams[int.from_bytes(b[at + 1 : at + 3], "big") & 0x1FFF] = b[at]
                at += 5 + (int.from_bytes(b[at + 3 : at + 5], "big") & 0xFFF)
    out = {"packets": n, "lost_sync": lost, "programs": sorted(set(programs)), "streams": sorted(streams.items()), "gaps": 0, "pts": [], "random_access": [], "units": 0, "payload": b""}
    payload = []
    for s in sorted(streams):
        where = np.flatnonzero((pid == s) & (packets[:, 3] & 0x10 > 0))
        own = packets[where]
        if not len(own):
            continue
        counter, field = own[:, 3] & 15, own[:, 3] & 0x20 > 0
        step = (counter[1:].astype(np.int16) - counter[:-1]) % 16
        out["gaps"] += int(((step != 1) & (step != 0)).sum())
        keep = np.r_[True, step != 0]  # a repeated counter is a duplicate packet
        start = np.where(field, 5 + own[:, 4].astype(np.int32), 4)
        flagged = field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        out["random_access"] += where[flagged & keep].tolist()
        mask = (np.arange(PACKET)[None, :] >= start[:, None]) & keep[:, None]
        heads = np.flatnonzero((own[:, 1] & 0x40 > 0) & keep)
        sizes = np.where(keep, np.maximum(PACKET - start, 0), 0)
        stream, at = own[mask].tobytes(), np.r_[0, np.cumsum(sizes)]
        for a, b in zip(heads, [*heads[1:], len(own)], strict=True):
            pes = stream[at[a] : at[b]]
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                continue
            size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            if pes[7] & 0x80 and len(pes) >= 14:
                out["pts"].append(read_pts(pes[9:14]))
            out["units"] += 1
            payload.append(pes[head : 6 + size] if size else pes[head:])
    out["payload"] = b"".join(payload)
    return out


def padded(raw: bytes, block: int = 64) -> bytes:
    """raw with zero bytes up to a positive multiple of block."""
    return raw + b"\0" * (-len(raw) % block if raw else block)


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a transport stream."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = common.raw_texts(b.column("text"))
            yield common.batch(schema, doc_id=b.column("doc_id"), n_bytes=[len(x) for x in raw], media=[write_stream(padded(x)) for x in raw])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digest columns and the parser's findings for each stored stream."""
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}
    schema = pa.schema(list(names.items()))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = common.raw_texts(b.column("media"))
            got = [parse_stream(x) for x in media]
            body = [x["payload"] for x in got]
            short = [json.dumps({k: x[k] for k in ("packets", "lost_sync", "programs", "streams", "gaps", "units")} | {"pts": [*x["pts"][:1], *x["pts"][-1:]], "random_access": len(x["random_access"])}) for x in got]
            yield common.batch(
                schema, doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), payload_bytes=[len(x) for x in body], payload_sha256=[hashlib.sha256(x).hexdigest() for x in body], tail_crc32=[zlib.crc32(x[-64:]) for x in body],
                media_bytes=[len(x) for x in media], media_sha256=[hashlib.sha256(x).hexdigest() for x in media], feature=short, pts=[x["pts"] for x in got], random_access=[x["random_access"] for x in got],
            )

    return media.mapInArrow(parse, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>")


def stored_features(docs: DataFrame) -> DataFrame:
    """media_features of the streams as read back from storage."""
    return media_features(common.stored(media_table(docs), "media"))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(common.read(spark, sf_dir, "documents"))
