"""Texts as Matroska audio, and Matroska bytes as packet tables.

The writer stores a payload losslessly as 8-bit PCM samples: frames of 576 samples, laced
into simple blocks, blocks into clusters, with cues to every cluster. The reader parses
any Matroska bytes: variable-length element ids and sizes (unknown sizes included),
clusters, simple blocks and block groups, all four lacings, and cues. It yields a table of
packets with track, timestamp and byte range.

Defined results: null and empty texts become one frame of padding; bytes that end inside
an element yield the packets before it; null media has no packets; an empty table gives an
empty table; other columns are carried along, and one named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

FRAME = 576
PAD = b"\xff"
RATE = 8000
FRAMES_PER_BLOCK = 8
FRAMES_PER_CLUSTER = 256
TIME_SCALE = 1_000_000
FRAME_MS = FRAME * 1000 // RATE

# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CUES, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675
TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP = 0xAE, 0xE1, 0xBB, 0xB7, 0xA0
SIMPLE_BLOCK, BLOCK, CLUSTER_TIME, TIMESTAMP_SCALE, REFERENCE = 0xA3, 0xA1, 0xE7, 0x2AD7B1, 0xFB
TRACK_NUMBER, DEFAULT_DURATION, CODEC_ID = 0xD7, 0x23E383, 0x86
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, CUES, CLUSTER, TRACK_ENTRY, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP}


class Packet(NamedTuple):
    track: int
    time_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    lacing: int


class Parsed(NamedTuple):
    packets: list[Packet]
    clusters: list[tuple[int, int]]  #: byte offset, time in scale units
    cues: list[tuple[int, int, int]]  #: time in scale units, track, byte offset of the cluster
    tracks: dict[int, str]


# -- writing ----------------------------------------------------------------------------


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return _id(ident) + _size(len(data)) + data


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = element(
    EBML,
    _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(0x9C, 1) + _uint(DEFAULT_DURATION, FRAME_MS * TIME_SCALE)
        + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8)),
    ),
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes padded to a positive multiple of the frame size, and their number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    frames = max(1, -(-len(data) // FRAME))
    return data.ljust(frames * FRAME, PAD), len(data)


def write(payload: bytes) -> bytes:
    """A Matroska file whose only track holds ``payload``, frame by frame."""
    frames = len(payload) // FRAME
    info = element(INFO, _uint(TIMESTAMP_SCALE, TIME_SCALE) + element(0x4489, struct.pack(">d", frames * FRAME_MS)) + element(0x4D80, b"tidemark") + element(0x5741, b"tidemark"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, FRAMES_PER_CLUSTER):
        last, blocks = min(frames, first + FRAMES_PER_CLUSTER), [_uint(CLUSTER_TIME, first * FRAME_MS)]
        for a in range(first, last, FRAMES_PER_BLOCK):
            b = min(last, a + FRAMES_PER_BLOCK)
            head = b"\x81" + struct.pack(">h", (a - first) * FRAME_MS)
            head += bytes([0x84, b - a - 1]) if b - a > 1 else b"\x80"  # fixed-size lacing, or none
            blocks += (_id(SIMPLE_BLOCK), _size(len(head) + (b - a) * FRAME), head, payload[a * FRAME : b * FRAME])
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


# -- reading ----------------------------------------------------------------------------


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; size -1 where all value bits are set.

    Raises IndexError past the end.
    """
    first = data[at]
    if not first:
        raise IndexError("no vint of at most eight bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise IndexError("vint is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, start, data start and data end of every element in a range; masters are entered."""
    while at < end:
        start = at
        try:
            ident, at = vint(data, at, keep_marker=True)
            size, at = vint(data, at)
        except IndexError:
            return
        stop = end if size < 0 else at + size
        if ident in _MASTERS:
            yield ident, start, at, min(stop, end)
            continue  # its children follow in place
        if stop > end:
            return
        yield ident, start, at, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Offset and size of each frame of a block body that starts at ``at``."""
    if not lacing:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:  # fixed size
        sizes = [(end - at) // count] * count
    elif lacing == 1:  # Xiph: runs of 255
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:  # EBML: the first size, then signed differences
        for k in range(count - 1):
            width = 9 - data[at].bit_length()
            n, at = vint(data, at)
            if n < 0:
                n = (1 << 7 * width) - 1
            sizes.append(n if k == 0 else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise IndexError("lacing leaves the block")
        out.append((at, n))
        at += n
    return out


def parse(data: bytes) -> Parsed:
    """The packets, clusters, cues and tracks of Matroska bytes."""
    packets: list[Packet] = []
    clusters: list[tuple[int, int]] = []
    cues: list[tuple[int, int, int]] = []
    tracks: dict[int, str] = {}
    durations: dict[int, int] = {}
    scale, base, track, cue, segment = TIME_SCALE, 0, 0, [0, 0], 0
    for ident, start, a, b in elements(data, 0, len(data)):
        if ident in (SIMPLE_BLOCK, BLOCK):
            try:
                number, at = vint(data, a)
                offset, flags = struct.unpack_from(">hB", data, at)
                frames = laced(data, at + 3, b, flags >> 1 & 3)
            except (IndexError, struct.error):
                break
            time, step = (clusters[-1][1] + offset) * scale, durations.get(number, 0)
            packets += (Packet(number, time + k * step, o, n, bool(flags & 0x80) or ident == BLOCK, len(clusters) - 1, flags >> 1 & 3) for k, (o, n) in enumerate(frames))
        elif ident == REFERENCE and packets:
            packets[-1] = packets[-1]._replace(keyframe=False)
        elif ident == CLUSTER:
            clusters.append((start, 0))
        elif ident == CLUSTER_TIME and clusters:
            clusters[-1] = (clusters[-1][0], _number(data, a, b))
        elif ident == SEGMENT:
            segment = a
        elif ident == TIMESTAMP_SCALE:
            scale = _number(data, a, b)
        elif ident == TRACK_NUMBER:
            track = _number(data, a, b)
            tracks[track] = ""
        elif ident == CODEC_ID:
            tracks[track] = data[a:b].decode("ascii", "replace")
        elif ident == DEFAULT_DURATION:
            durations[track] = _number(data, a, b)
        elif ident == CUE_TIME:
            cue[0] = _number(data, a, b)
        elif ident == CUE_TRACK:
            cue[1] = _number(data, a, b)
        elif ident == CUE_CLUSTER:
            cues.append((cue[0], cue[1], segment + _number(data, a, b)))
    return Parsed(packets, clusters, cues, tracks)


def stored_payload(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The bytes of a track's packets, in order."""
    return b"".join(data[p.offset : p.offset + p.size] for p in parsed.packets if p.track == track)


def feature(payload: bytes, parsed: Parsed) -> str:
    """Counts of the container and integer statistics of the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    indexed = {start for start, _ in parsed.clusters} == {at for _, _, at in parsed.cues}
    end = max((p.time_ns for p in parsed.packets), default=0)
    return (
        f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};indexed={int(indexed)};last_ns={end};"
        f"sum={samples.sum()};energy={(samples * samples).sum()};crossings={crossings};peak={np.abs(samples).max(initial=0)}"
    )


# -- columns ----------------------------------------------------------------------------


def _extended(df: DataFrame, added: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in added), *(f"{k} {v}" for k, v in added.items())])


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns} | columns)


def media_column(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``media binary`` (the text as Matroska) and ``n_bytes bigint`` (its UTF-8 length)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        padded = [payload_of(x) for x in batch.column(text).to_pylist()]
        return _with(batch, {"n_bytes": pa.array([n for _, n in padded], pa.int64()), "media": pa.array([write(p) for p, _ in padded], pa.binary())})

    return map_arrow(df, run, _extended(df, {"n_bytes": "bigint", "media": "binary"}))


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per packet: the columns of ``df`` but for the media, and the packet's fields."""
    kinds = {"track": "int", "time_ns": "bigint", "offset": "bigint", "size": "bigint", "keyframe": "boolean", "cluster": "int", "lacing": "int"}
    kept = [c for c in df.columns if c != media and c not in kinds]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parse(x).packets if x else [] for x in batch.column(media).to_pylist()]
        source = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        flat = [p for r in rows for p in r]
        types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
        columns = {c: batch.column(c).take(source) for c in kept}
        return pa.RecordBatch.from_pydict(columns | {k: pa.array([p[i] for p in flat], types[t]) for i, (k, t) in enumerate(kinds.items())})

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in kinds.items())])
    return map_arrow(df, run, schema)


_DIGESTS = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def media_digests(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without its media, with what is read back from it."""

    def digest(data: bytes) -> tuple:
        parsed = parse(data)
        payload = stored_payload(data, parsed)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, parsed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [digest(x or b"") for x in batch.column(media).to_pylist()]
        columns = {k: pa.array([r[i] for r in rows], pa.int64() if t == "bigint" else pa.string()) for i, (k, t) in enumerate(_DIGESTS.items())}
        out = _with(batch, columns)
        return out.select([n for n in out.schema.names if n != media])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in _DIGESTS and f.name != media)
    return map_arrow(df, run, f"{kept}, " + ", ".join(f"{k} {v}" for k, v in _DIGESTS.items()))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = media_column(docs).select("doc_id", "n_bytes", "media")
    return media_digests(media).select("doc_id", "n_bytes", *map(F.col, _DIGESTS))
