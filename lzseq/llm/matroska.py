"""Matroska: writes a payload as an 8-bit audio track and reads packet tables back from the bytes.

An EBML element is an id (1 to 4 bytes, marker kept), a size (1 to 8 bytes, marker removed; all value bits set: unknown)
and a body. Packets are the frames of SimpleBlocks and BlockGroups, with every kind of lacing: none, Xiph, fixed, EBML.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import by_text

# Element ids of the EBML and Matroska formats.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x114D9B74, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))
#: Elements that end a cluster or segment of unknown size.
TOP = frozenset((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES))


class Malformed(ValueError):
    """The bytes end inside an element, or an element contradicts itself."""


def id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as a variable-length size; the value with all bits set is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return id_bytes(name) + size_bytes(len(body)) + body


def unsigned(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(name: int, x: float) -> bytes:
    import struct

    return element(name, struct.pack(">d", x))


def read_id(b, at: int) -> tuple[int, int]:
    if at >= len(b):
        raise Malformed("an element id is missing")
    first = b[at]
    width = 9 - first.bit_length() if first else 9
    if width > 4 or at + width > len(b):
        raise Malformed("an element id is too long")
    return int.from_bytes(b[at : at + width], "big"), at + width


def read_size(b, at: int) -> tuple[int | None, int, int]:
    """(value or None where unknown, its end, its width)."""
    if at >= len(b):
        raise Malformed("a size is missing")
    first = b[at]
    width = 9 - first.bit_length() if first else 9
    if width > 8 or at + width > len(b):
        raise Malformed("a size is too long")
    n = int.from_bytes(b[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width, width


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ns: int
    start: int
    size: int
    keyframe: bool
    cluster: int


def lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """(flag bits, body after the block's flags). kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0 or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return 0, frames[0]
    if len(frames) > 256:
        raise ValueError("a block holds 256 frames at most")
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 2:
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of one size")
    else:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return kind << 1, head + b"".join(frames)


def unlace(b, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges (start, size) of a block's frames."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("a lace has no frame count")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise Malformed("a fixed lace does not divide evenly")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed("a Xiph lace is cut")
                    x, at = b[at], at + 1
                    size += x
                    if x < 255:
                        break
            else:
                raw, at, width = read_size(b, at)
                if raw is None:
                    raw = (1 << 7 * width) - 1
                size = raw if i == 0 else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
            if size < 0 or at > end:
                raise Malformed("a lace size is out of range")
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if sizes[-1] < 0:
            raise Malformed("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """{doc_type, scale, duration, tracks, packets, cues, clusters}; raises Malformed where the bytes are cut or inconsistent."""
    b = memoryview(data)
    out = {"doc_type": "", "scale": 1_000_000, "duration": None, "tracks": {}, "packets": [], "cues": [], "clusters": []}
    state = {"segment": 0, "cluster_time": 0, "cluster": 0}

    def number(at, end):
        return int.from_bytes(b[at:end], "big")

    def decimal(at, end):
        import struct

        return struct.unpack(">f" if end - at == 4 else ">d", b[at:end])[0] if end - at in (4, 8) else 0.0

    def block(at, end):
        track, at, _ = read_size(b, at)
        if at + 3 > end:
            raise Malformed("a block is cut")
        relative = int.from_bytes(b[at : at + 2], "big", signed=True)
        flags = b[at + 2]
        ranges = unlace(b, at + 3, end, flags >> 1 & 3)
        step = out["tracks"].get(track, {}).get("frame_ns", 0)
        for i, (start, size) in enumerate(ranges):
            out["packets"].append(Packet(track, (state["cluster_time"] + relative) * out["scale"] + i * step, start, size, bool(flags & 0x80), state["cluster"]))

    def walk(at, end, inside, into, depth=0):
        if depth > 16:
            raise Malformed("elements are nested too deep")
        while at < end:
            began = at
            name, at = read_id(b, at)
            if inside == CLUSTER and name in TOP:
                return began
            size, at, _ = read_size(b, at)
            stop = end if size is None else at + size
            if stop > end:
                raise Malformed("an element is longer than its parent")
            if name in MASTERS:
                child = into
                if name == SEGMENT:
                    state["segment"] = at
                elif name == CLUSTER:
                    state["cluster"] = len(out["clusters"])
                    out["clusters"].append(began - state["segment"])
                elif name in (TRACK_ENTRY, CUE_POINT):
                    child = {}
                at = walk(at, stop, name, child, depth + 1)
                if name == TRACK_ENTRY:
                    out["tracks"][child.get("number", len(out["tracks"]) + 1)] = child
                elif name == CUE_POINT:
                    out["cues"].append((child.get("time", 0), child.get("track", 0), child.get("position", 0)))
                continue
            if size is None:
                raise Malformed("only a segment or a cluster may have an unknown size")
            if name == DOC_TYPE:
                out["doc_type"] = bytes(b[at:stop]).rstrip(b"\0").decode("ascii", "replace")
            elif name == TIMESTAMP_SCALE:
                out["scale"] = number(at, stop)
            elif name == DURATION:
                out["duration"] = decimal(at, stop)
            elif name == CLUSTER_TIMESTAMP:
                state["cluster_time"] = number(at, stop)
            elif name == TRACK_NUMBER:
                into["number"] = number(at, stop)
            elif name == TRACK_TYPE:
                into["type"] = number(at, stop)
            elif name == DEFAULT_DURATION:
                into["frame_ns"] = number(at, stop)
            elif name == CODEC_ID:
                into["codec"] = bytes(b[at:stop]).decode("ascii", "replace")
            elif name == SAMPLING_FREQUENCY:
                into["rate"] = decimal(at, stop)
            elif name == CHANNELS:
                into["channels"] = number(at, stop)
            elif name == BIT_DEPTH:
                into["bits"] = number(at, stop)
            elif name == CUE_TIME:
                into["time"] = number(at, stop)
            elif name == CUE_TRACK:
                into["track"] = number(at, stop)
            elif name == CUE_CLUSTER_POSITION:
                into["position"] = number(at, stop)
            elif name in (SIMPLE_BLOCK, BLOCK):
                block(at, stop)
            at = stop
        return at

    walk(0, len(b), 0, {})
    return out


RATE, FRAME = 8000, 192
#: Fixed values of the layout: frames in a laced block, blocks in a cluster.
LACED, BLOCKS = 64, 16


def mux(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples; the payload's length is a multiple of FRAME. A tick is one frame."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    n = len(payload) // FRAME
    info = element(INFO, unsigned(TIMESTAMP_SCALE, FRAME * 1_000_000_000 // RATE) + real(DURATION, float(n)) + element(MUXING_APP, b"lzseq") + element(WRITING_APP, b"lzseq"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, n, LACED * BLOCKS):
        parts = [unsigned(CLUSTER_TIMESTAMP, c)]
        for s in range(c, min(n, c + LACED * BLOCKS), LACED):
            count = min(LACED, n - s)
            data = payload[s * FRAME : (s + count) * FRAME]
            flags, data = (0, data) if count == 1 else (2 << 1, bytes([count - 1]) + data)
            parts.append(element(SIMPLE_BLOCK, size_bytes(1) + (s - c).to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, c) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def demux(data: bytes, track: int = 1) -> tuple[bytes, dict]:
    """The stored samples of a track in packet order, and the parsed tables."""
    info = parse(data)
    runs: list[list[int]] = []  # frames that follow each other in the file are read at once
    for p in info["packets"]:
        if p.track == track:
            if runs and runs[-1][1] == p.start:
                runs[-1][1] += p.size
            else:
                runs.append([p.start, p.start + p.size])
    return b"".join(data[a:z] for a, z in runs), info


def packet_table(files: DataFrame, id_column: str = "doc_id", data_column: str = "media") -> DataFrame:
    """One row for each packet of each Matroska file in data_column: id, packet, track, timestamp_ns, byte_start, byte_size, keyframe, cluster.

    Null or empty bytes have no packets. Malformed bytes give one row whose packet is -1 and whose error tells why; the packets before the fault aren't given.
    """
    schema = f"{id_column} bigint, packet bigint, track bigint, timestamp_ns bigint, byte_start bigint, byte_size bigint, keyframe boolean, cluster bigint, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not data:
                    continue
                try:
                    info = parse(data)
                    rows += [(key, i, p.track, p.timestamp_ns, p.start, p.size, p.keyframe, p.cluster, None) for i, p in enumerate(info["packets"])]
                except Malformed as e:
                    rows.append((key, -1, None, None, None, None, None, None, str(e)))
            types = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    from pyspark.sql import functions as F

    names = [x.split()[0] for x in schema.split(", ")]
    return files.select(F.col(id_column).cast("bigint").alias(id_column), F.col(data_column).alias("data")).mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    """The text with bytes 32 up to a positive multiple of FRAME."""
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME), b" ")


def features(samples: bytes, info: dict) -> str:
    """Packets, clusters, cues, duration in ms, and of the samples mean, variance (both in thousandths, rounded down) and crossings of the middle value."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, len(x))
    total, squares = int(x.sum(dtype=np.int64)), int(np.bincount(x, minlength=256).astype(np.int64) @ (np.arange(256, dtype=np.int64) ** 2))
    high = x >= 96
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    packets = len(info["packets"])
    ms = packets * info["scale"] // 1_000_000
    return f"packets={packets};clusters={len(info['clusters'])};cues={len(info['cues'])};ms={ms};mean={1000 * total // n};var={1000 * (n * squares - total * total) // (n * n)};cross={crossings}"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as Matroska, parses the stored bytes and returns digests of what was read back.

    Null and empty texts are one frame of spaces. Repeated rows give repeated results. Only doc_id and text are read.
    """

    def run(texts):
        cols = [[], [], [], [], [], [], []]
        for t in texts:
            data = mux(padded(t))
            samples, info = demux(data)
            for c, v in zip(cols, (len(t), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(samples, info))):
                c.append(v)
        return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]

    return by_text(docs, run, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
