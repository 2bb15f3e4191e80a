"""Media columns: payloads in MPEG transport streams.

`encode` cuts a payload into access units, each one PES packet with a presentation timestamp; the first packet of a
unit carries the random-access flag. Program tables (PAT, PMT) lead the stream. `decode` parses the program tables,
checks their checksums and every continuity counter, reassembles the PES packets of the program's elementary stream
and gives the timestamps with their byte positions and random-access flags.

Edge cases: null text is empty; a payload is padded with zero bytes to a positive multiple of 64, its own length
stands in a private descriptor; equal texts give equal streams; an empty table gives an empty table; other columns
are ignored. A very long text is one stream, which its task holds whole, with its payload; clocks wrap at 33 bits.
A damaged stream gives counts of its faults, not an exception, whatever bytes are wrong.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, released, stage, texts

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID = 188, 0x47, 0, 0x1000, 0x0100
#: Private data stream; ticks of a unit at 25 units a second on the 90 kHz clock; bytes of a unit; tag of the length descriptor.
STREAM_ID, STREAM_TYPE, TICKS, UNIT, TAG = 0xBD, 0x06, 3600, 4096, 0x80
CRC_TABLE = []
for _n in range(256):
    _c = _n << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    CRC_TABLE.append(_c)


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table: int, key: int, body: bytes) -> bytes:
    """A program table as the payload of one packet."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\0\0"
    s = head + body
    s = b"\0" + s + crc_mpeg(s).to_bytes(4, "big")
    return s + b"\xff" * (PACKET - 4 - len(s))


PAT = bytes([SYNC, 0x40, 0, 0x10]) + _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))


def _pts(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E]) + ((t >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((t & 0x7FFF) << 1 | 1).to_bytes(2, "big")


def encode(payload: bytes, length: int) -> bytes:
    """The transport stream of a payload, whose first `length` bytes are its own."""
    about = bytes([TAG, 8]) + length.to_bytes(8, "big")
    pmt = (0xE000 | DATA_PID).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
    out = [PAT, bytes([SYNC, 0x40 | PMT_PID >> 8, PMT_PID & 255, 0x10]), _section(2, 1, pmt)]
    counter, low, high = 0, DATA_PID & 255, DATA_PID >> 8
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts(k * TICKS) + unit
        here, first = 0, True
        while here < len(pes):
            room = PACKET - 4 - 2 * first
            n = min(room, len(pes) - here)
            spare = PACKET - 4 - n  # bytes of the adaptation field with its length
            if spare:
                flags = b"\x40" if first else b"\0"
                field = bytes([spare - 1]) + (flags + b"\xff" * (spare - 2) if spare > 1 else b"")
            else:
                field = b""
            out.append(bytes([SYNC, high | 0x40 * first, low, (0x30 if field else 0x10) | counter]) + field + pes[here : here + n])
            counter, here, first = counter + 1 & 15, here + n, False
    return b"".join(out)


def _checked_section(data: bytes, table: int) -> bytes | None:
    """The section of a table that a packet's data begins, if it lies in the packet and its checksum is right."""
    s = data[1 + data[0] :] if data else b""
    if len(s) < 16 or s[0] != table:
        return None
    n = 3 + ((s[1] & 15) << 8 | s[2])
    return None if n < 16 or n > len(s) or crc_mpeg(s[:n]) else s[:n]


def decode(stream: bytes) -> dict:
    """Payload, its own length, timestamps (ticks, byte position, random access) and the faults found."""
    found = {"payload": b"", "length": None, "units": [], "packets": len(stream) // PACKET, "sync_errors": int(len(stream) % PACKET > 0), "continuity_errors": 0, "table_errors": 0}
    pmt_pid = data_pid = None
    counters: dict[int, int] = {}
    parts: list[bytes] = []
    size = 0
    units: list[tuple[int, bool, list]] = []
    for at in range(0, len(stream) - PACKET + 1, PACKET):
        sync, a, b, c = stream[at : at + 4]
        if sync != SYNC:
            found["sync_errors"] += 1
            continue
        pid, begins, here, random = (a & 31) << 8 | b, a & 0x40, at + 4, False
        if c & 0x20:
            n = stream[here]
            if n > PACKET - 5:  # an adaptation field beyond its packet
                found["sync_errors"] += 1
                continue
            random = n > 0 and bool(stream[here + 1] & 0x40)
            here += n + 1
        if not c & 0x10:
            continue
        if pid in counters and c & 15 != counters[pid] + 1 & 15:
            found["continuity_errors"] += 1
        counters[pid] = c & 15
        data = stream[here : at + PACKET]
        if pid == PAT_PID or pid == pmt_pid:
            s = _checked_section(data, 0 if pid == PAT_PID else 2)
            if s is None:
                found["table_errors"] += 1
            elif pid == PAT_PID:
                pmt_pid = (s[10] & 31) << 8 | s[11]
            else:
                end = 12 + ((s[10] & 15) << 8 | s[11])
                if end + 5 > len(s) - 4:  # no room for an elementary stream before the checksum
                    found["table_errors"] += 1
                    continue
                k = 12
                while k + 2 <= end and k + 2 + s[k + 1] <= end:
                    if s[k] == TAG:
                        found["length"] = int.from_bytes(s[k + 2 : k + 2 + s[k + 1]], "big")
                    k += 2 + s[k + 1]
                data_pid = (s[end + 1] & 31) << 8 | s[end + 2]
        elif pid == data_pid:
            if begins:
                parts = []
                units.append((0, random, parts))
            if units:
                parts.append(data)
    whole = []
    for _, random, parts in units:
        pes = b"".join(parts)
        n = int.from_bytes(pes[4:6], "big")
        # a packet cut short, or one whose header has no room for a timestamp or is longer than the packet
        if pes[:3] != b"\0\0\1" or len(pes) < n + 6 or n < 8 or not 5 <= pes[8] <= n - 3:
            found["continuity_errors"] += 1
            continue
        t = pes[9:14]
        ticks = (t[0] & 0x0E) << 29 | (int.from_bytes(t[1:3], "big") >> 1) << 15 | int.from_bytes(t[3:5], "big") >> 1
        body = pes[9 + pes[8] : 6 + n]
        found["units"].append((ticks, size, random))
        size += len(body)
        whole.append(body)
    found["payload"] = b"".join(whole)
    return found


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its text's stream (media)."""

    def run(batches):
        for ids, batch in texts(batches):
            media = []
            for text in batch:
                data = text.encode("utf-8", "surrogatepass")
                media.append(encode(data + bytes(-len(data) % 64 or 64 * (not data)), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, media binary")


def load(stored: DataFrame) -> DataFrame:
    """Streams with what they hold: n_bytes, payload, units (ticks, position, random access), packets and faults."""
    units = pa.list_(pa.struct([("ticks", pa.int64()), ("position", pa.int64()), ("random_access", pa.bool_())]))
    names = ("packets", "sync_errors", "continuity_errors", "table_errors")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [decode(x) for x in part.column(1).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array([x["length"] for x in found], pa.int64()), pa.array([x["payload"] for x in found], pa.binary())]
                columns.append(pa.array([[dict(zip(("ticks", "position", "random_access"), u, strict=True)) for u in x["units"]] for x in found], units))
                columns += [pa.array([x[n] for x in found], pa.int64()) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "media", "n_bytes", "payload", "units", *names])

    return stored.select("doc_id", "media").mapInArrow(released(run), "doc_id long, media binary, n_bytes long, payload binary, units array<struct<ticks:long,position:long,random_access:boolean>>, packets long, sync_errors long, continuity_errors long, table_errors long")


def features() -> F.Column:
    """One string of what `load` found in a stream."""
    last = F.try_element_at("units", F.lit(-1))
    return F.concat_ws(";", *(F.concat(F.lit(f"{name}="), x.cast("string")) for name, x in (("packets", F.col("packets")), ("units", F.size("units")), ("random_access", F.size(F.filter("units", lambda u: u["random_access"]))), ("last_ticks", last["ticks"]), ("faults", F.col("sync_errors") + F.col("continuity_errors") + F.col("table_errors")))))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """`load` of the streams of a table, stored in the shared folder in between."""
    return load(stage(store(docs, **options), "media"))
