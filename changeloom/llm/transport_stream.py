"""Media columns: MPEG transport streams in a binary column.

A stream holds a program association table, a program map table and one private
data stream. Every elementary packet carries ``UNIT`` payload bytes at most and a
presentation time; every ``RAP_EVERY``-th is marked as a random-access point and
carries a clock reference. Parsing reads the tables to find the stream, checks
continuity counters, puts elementary packets together again and returns their
times and which are random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD
UNIT, RAP_EVERY, TICKS = 36_864, 8, 3_600


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return packet.ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(ticks: int) -> bytes:
    """33 bits of time between marker bits, as elementary packets hold them."""
    return struct.pack(">BHH", 0x21 | ticks >> 29 & 0x0E, ticks >> 14 & 0xFFFE | 1, ticks << 1 & 0xFFFE | 1)


def _packet(begins: bool, counter: int, field: bytes, data: bytes) -> bytes:
    """One packet; stuffing goes to the adaptation field, made where there is none."""
    short = PACKET - 4 - len(field) - len(data)
    if short and field:
        field = bytes([field[0] + short]) + field[1:] + b"\xff" * short
    elif short:
        field = bytes([short - 1]) + (b"\0" + b"\xff" * (short - 2) if short > 1 else b"")
    return struct.pack(">BHB", SYNC, 0x4000 * begins | DATA_PID, (0x30 if field else 0x10) | counter & 15) + field + data


def _unit_packets(data: bytes, number: int, counter: int) -> bytes:
    """One elementary packet as transport packets, stuffed so that they end with it."""
    ticks = number * TICKS & (1 << 33) - 1
    body = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(ticks) + data
    field = b"\x07\x50" + struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00) if number % RAP_EVERY == 0 else b""
    room = PACKET - 4 - len(field)
    out = [_packet(True, counter, field, body[:room])]
    full, last = divmod(max(0, len(body) - room), PACKET - 4)
    if full:
        block = np.empty((full, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        block[:, 3] = 0x10 | (counter + 1 + np.arange(full) & 15)
        block[:, 4:] = np.frombuffer(body, np.uint8, full * (PACKET - 4), room).reshape(full, -1)
        out.append(block.tobytes())
    if last:
        out.append(_packet(False, counter + 1 + full, b"", body[-last:]))
    return b"".join(out)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [TABLES], 0
    for number, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        packets = _unit_packets(payload[at : at + UNIT], number, counter)
        counter = counter + len(packets) // PACKET & 15
        out.append(packets)
    return b"".join(out)


def _table_body(packet: np.ndarray) -> bytes:
    raw = packet.tobytes()[4:]
    raw = raw[1 + raw[0] :]
    size = struct.unpack(">H", raw[1:3])[0] & 0x0FFF
    section = raw[: 3 + size]
    if crc32_mpeg(section):
        raise ValueError("a program table's checksum is wrong")
    return section[8:-4]


def demux(stream: bytes) -> dict:
    """payload, times (90 kHz), random-access points (numbers of elementary
    packets), packets and breaks in the continuity counters."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("synchronisation is lost")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pmt = struct.unpack(">H", _table_body(packets[np.argmax(pid == 0)])[2:4])[0] & 0x1FFF
    body = _table_body(packets[np.argmax(pid == pmt)])
    info = struct.unpack(">H", body[2:4])[0] & 0x0FFF
    wanted = struct.unpack(">H", body[4 + info + 1 : 4 + info + 3])[0] & 0x1FFF
    own = packets[pid == wanted]
    counters = own[:, 3] & 15
    breaks = int(((np.diff(counters.astype(np.int16)) & 15) != 1).sum())
    start, adapted = own[:, 1] & 0x40 != 0, own[:, 3] & 0x20 != 0
    skip = np.where(adapted, own[:, 4].astype(np.int64) + 1, 0)
    random_access = start & adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)
    keep = np.arange(PACKET - 4) >= skip[:, None]
    content = own[:, 4:]
    data = content.tobytes() if keep.all() else content[keep].tobytes()
    sizes = PACKET - 4 - skip
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1][start]
    parts, times = [], []
    for at, end in zip(begins.tolist(), [*begins.tolist()[1:], len(data)], strict=True):
        code, length, _, flags, head = struct.unpack(">IHBBB", data[at : at + 9])
        if code >> 8 != 1 or not flags & 0x80 or at + 6 + length != end:
            raise ValueError("an elementary packet is damaged")
        a, b, c = struct.unpack(">BHH", data[at + 9 : at + 14])
        times.append((a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1)
        parts.append(data[at + 9 + head : end])
    return {"payload": b"".join(parts), "times": times, "random_access": np.flatnonzero(random_access[start]).tolist(), "packets": len(packets), "breaks": breaks}


BLOCK = 576


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes and bytes 255 up to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text, padded, as a transport stream.

    A null text counts as an empty one; null and repeated ids keep a row each;
    other columns are ignored, whatever their names.
    """
    id_type = dict(docs.dtypes)[id_col]

    def write(rows: dict) -> dict:
        return {
            "id": rows["id"],
            "n_bytes": [len((x or "").encode("utf-8", "replace")) for x in rows["text"]],
            "media": [mux(padded(x)) for x in rows["text"]],
        }

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), write, f"id {id_type}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored streams of ``media`` (id, n_bytes, media) hold.

    payload_* describe the payload read back; times has the elementary packets'
    presentation times and random_access the numbers of those at which decoding
    can begin. A null stream gives nulls; a damaged one is an error.
    """
    id_type = dict(media.dtypes)["id"]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "packets", "breaks", "times", "random_access"]

    def read(rows: dict) -> dict:
        out = {"id": rows["id"], "n_bytes": rows["n_bytes"]} | {n: [] for n in names}
        for stream in rows["media"]:
            found = demux(stream) if stream is not None else None
            payload = found and found["payload"]
            values = found and [
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(),
                found["packets"], found["breaks"], found["times"], found["random_access"],
            ]
            for name, value in zip(names, values or [None] * len(names), strict=True):
                out[name].append(value)
        return out

    return map_batches(media, read, f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, breaks long, times array<long>, random_access array<int>")
