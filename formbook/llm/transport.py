"""Media columns as MPEG transport streams.

``mux`` stores a text's bytes in a transport stream of one programme: a programme
association table, a programme map table, and one private-data elementary stream whose
packets carry timestamps; every packet that starts an access unit is a random-access point.
``demux`` is the general reader: it walks 188-byte packets, reads the tables (checking their
CRC), follows each stream's continuity counter, reassembles the elementary packets and
returns payload, timestamps and random-access points.  A text is handled on its own, so
work is a narrow map over the documents; nothing is shuffled.

Edge cases: a null text is empty (64 zero bytes); repeated rows give equal streams;
a null or damaged stream gives no payload but a row, with ``ok`` false and what was found
(bad packets, broken counters, bad tables); an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.llm.common import query, table

# Fixed values of the transport-stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_DATA = 0x06
PRIVATE_STREAM_1 = 0xBD
CRC_POLY = 0x04C11DB7

# This writer's choices.
PMT_PID, ES_PID, PROGRAM = 0x0100, 0x0101, 1
PAD = 64
ACCESS_UNIT = 32 * 1024  # payload bytes of one elementary packet
TICKS = 3600  # 90 kHz ticks between elementary packets


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (PAD if not data else 0))


# ---- writing ----------------------------------------------------------------


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10)
    return (head + b"\0" + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)))


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _packets(pes: bytes, counter: int, out: list[bytes]) -> int:
    """Cut an elementary packet into transport packets; returns the next continuity counter.

    The first carries an adaptation field with the random-access flag, the last is stuffed.
    """
    at, first, n = 0, True, len(pes)
    while at < n:
        room = PACKET - 4 - (2 if first else 0)
        take = min(room, n - at)
        field = b""
        if first or take < room:
            size = PACKET - 4 - take
            flags = 0x40 if first else 0x00
            field = bytes((size - 1, flags)) + b"\xff" * (size - 2) if size > 1 else b"\0"
        out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | ES_PID, (0x30 if field else 0x10) | counter) + field + pes[at:at + take])
        counter = (counter + 1) & 15
        at += take
        first = False
    return counter


def mux(payload: bytes, access_unit: int = ACCESS_UNIT) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), access_unit)):
        unit = payload[at:at + access_unit]
        head = b"\x00\x00\x01" + struct.pack(">BHBBB", PRIVATE_STREAM_1, len(unit) + 8, 0x84, 0x80, 5) + _timestamp(k * TICKS & 0x1FFFFFFFF)
        counter = _packets(head + unit, counter, out)
    return b"".join(out)


# ---- reading ----------------------------------------------------------------


class Demuxer:
    """State of reading one transport stream."""

    def __init__(self) -> None:
        self.programs: dict[int, int] = {}  # PMT pid -> programme
        self.streams: dict[int, int] = {}  # elementary pid -> stream type
        self.counters: dict[int, int] = {}
        self.open: dict[int, list[bytes]] = {}
        self.units: list[tuple[int, int | None, int, bytes]] = []  # pid, pts, first packet, bytes
        self.started: dict[int, int] = {}
        self.random_access: list[int] = []
        self.packets = self.bad_packets = self.discontinuities = self.bad_tables = 0

    def _table(self, pid: int, data: bytes) -> None:
        section = data[1 + data[0]:] if data else b""
        length = 3 + (struct.unpack_from(">H", section, 1)[0] & 0x0FFF) if len(section) >= 8 else 0
        if not 12 <= length <= len(section) or crc32_mpeg(section[:length]) != 0:
            self.bad_tables += 1
            return
        body = section[8:length - 4]
        if pid == PAT_PID:
            for k in range(0, len(body) - 3, 4):
                program, target = struct.unpack_from(">HH", body, k)
                if program:
                    self.programs[target & 0x1FFF] = program
            return
        at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
        while at + 5 <= len(body):
            kind, target, info = struct.unpack_from(">BHH", body, at)
            self.streams[target & 0x1FFF] = kind
            at += 5 + (info & 0x0FFF)

    def _close(self, pid: int) -> None:
        parts = self.open.pop(pid, None)
        if parts is None:
            return
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or 9 + pes[8] > len(pes):
            self.bad_packets += 1
            return
        declared = struct.unpack_from(">H", pes, 4)[0]
        end = 6 + declared if declared else len(pes)
        if end > len(pes):
            self.bad_packets += 1
            return
        pts = _read_timestamp(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else None
        self.units.append((pid, pts, self.started[pid], pes[9 + pes[8]:end]))

    def feed(self, data: bytes) -> None:
        for at in range(0, len(data), PACKET):
            index, self.packets = self.packets, self.packets + 1
            packet = data[at:at + PACKET]
            if len(packet) < PACKET or packet[0] != SYNC or packet[1] & 0x80:
                self.bad_packets += 1
                continue
            pid = (packet[1] & 0x1F) << 8 | packet[2]
            if pid == NULL_PID:
                continue
            control, counter, start = packet[3] >> 4 & 3, packet[3] & 15, packet[1] & 0x40
            body, flags = 4, 0
            if control & 2:
                flags = packet[5] if packet[4] else 0
                body += 1 + packet[4]
            if not control & 1:
                continue
            last = self.counters.get(pid)
            self.counters[pid] = counter
            if last is not None and not flags & 0x80:
                if counter == last:
                    continue  # a repeated packet
                if counter != (last + 1) & 15:
                    self.discontinuities += 1
                    self.open.pop(pid, None)  # what was open lost bytes
            if pid == PAT_PID or pid in self.programs:
                if start:
                    self._table(pid, packet[body:])
            elif pid in self.streams:
                if start:
                    self._close(pid)
                    self.open[pid], self.started[pid] = [], index
                    if flags & 0x40:
                        self.random_access.append(index)
                if pid in self.open:
                    self.open[pid].append(packet[body:])

    def finish(self) -> None:
        for pid in list(self.open):
            self._close(pid)

    @property
    def ok(self) -> bool:
        return bool(self.streams) and not (self.bad_packets or self.discontinuities or self.bad_tables)


def demux(data: bytes | None) -> Demuxer:
    reader = Demuxer()
    reader.feed(data or b"")
    reader.finish()
    return reader


# ---- DataFrame operators ----------------------------------------------------

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PARSED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("ok", pa.bool_()),
    ("n_packets", pa.int64()), ("bad_packets", pa.int64()), ("discontinuities", pa.int64()), ("bad_tables", pa.int64()),
    ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))])


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, and ``media``: its padded bytes as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [v or b"" for v in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(v)) for v in raw], pa.binary())], schema=_MEDIA)

    cols = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return cols.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """Parse ``media`` of (doc_id, n_bytes, media): payload, packet checks, timestamps and the
    packet numbers of random-access points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [demux(v) for v in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([b"".join(u[3] for u in r.units) for r in read], pa.binary()), b.column(2),
                    pa.array([r.ok for r in read]), *(pa.array([getattr(r, k) for r in read], pa.int64()) for k in ("packets", "bad_packets", "discontinuities", "bad_tables")),
                    pa.array([[u[1] for u in r.units] for r in read], pa.list_(pa.int64())), pa.array([r.random_access for r in read], pa.list_(pa.int64()))]
            yield pa.record_batch(cols, schema=_PARSED)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload binary, media binary, ok boolean, n_packets long, bad_packets long, "
             "discontinuities long, bad_tables long, pts array<long>, random_access array<long>")


FEATURE = ("concat_ws(';', concat('ok=', ok), concat('packets=', n_packets), concat('units=', size(pts)), concat('first_pts=', coalesce(pts[0], -1)), "
           "concat('last_pts=', coalesce(try_element_at(pts, -1), -1)), concat('random_access=', array_join(random_access, ',')))")


@query("op7_transport_stream")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_media(store_media(table(spark, sf_dir, "documents")))
    return parsed.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -PAD, PAD)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.expr(FEATURE).alias("feature"))
