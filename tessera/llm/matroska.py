"""Operator 4: Matroska media columns.

``mux`` stores 8-bit PCM in a Matroska file and ``packets`` parses any Matroska file into its packet table: element
sizes of variable length, clusters, all four kinds of lacing, block groups, cues.  Both work on one media value at a
time inside Spark tasks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, written

UNIT = 576  # samples of a packet
RATE = 8000
PACKETS = "doc_id long, packet long, track int, timestamp long, at long, length long, cluster long, keyframe boolean, lacing string, cue boolean, problem string"
DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_packets long, n_clusters long, n_cues long, duration_ms long"
)

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS, AUDIO = 0xAE, 0xA0, 0xBB, 0xB7, 0xE1
TIMESTAMP_SCALE, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA1
TRACK_NUMBER, DEFAULT_DURATION, CUE_TIME, CUE_CLUSTER_POSITION = 0xD7, 0x23E383, 0xB3, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")


# --- writing -------------------------------------------------------------------------------------


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(n: int, body: bytes) -> bytes:
    return _id(n) + _size(len(body)) + body


def _uint(n: int, value: int) -> bytes:
    return _element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mux(payload: bytes, unit: int = UNIT, lace: int = 8, cluster_packets: int = 400) -> bytes:
    """A Matroska file with one PCM track: packets of ``unit`` bytes, ``lace`` to a block (fixed lacing), and cues."""
    scale = 1_000_000  # timestamps in milliseconds
    header = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, scale) + _element(0x4D80, b"tessera") + _element(0x5741, b"tessera"))
    audio = _element(AUDIO, _element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8))
    track = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(DEFAULT_DURATION, unit * 1_000_000_000 // RATE) + _element(0x86, b"A_PCM/INT/LIT") + audio)
    parts, points = [info, _element(TRACKS, track)], []
    at, n = sum(map(len, parts)), len(payload) // unit
    for first in range(0, n, cluster_packets):
        begin = first * unit * 1000 // RATE
        body = [_uint(CLUSTER_TIMESTAMP, begin)]
        for p in range(first, min(n, first + cluster_packets), lace):
            count = min(lace, first + cluster_packets - p, n - p)
            head = b"\x81" + struct.pack(">hB", p * unit * 1000 // RATE - begin, 0x84 if count > 1 else 0x80)
            body.append(_element(SIMPLE_BLOCK, head + (bytes([count - 1]) if count > 1 else b"") + payload[p * unit : (p + count) * unit]))
        parts.append(cluster := _element(CLUSTER, b"".join(body)))
        points.append(_element(CUE_POINT, _uint(CUE_TIME, begin) + _element(CUE_TRACK_POSITIONS, _uint(0xF7, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
    parts.append(_element(CUES, b"".join(points)))
    return header + _element(SEGMENT, b"".join(parts))


# --- reading -------------------------------------------------------------------------------------


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, where it ends, whether all value bits are set, the sign of an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"variable-length number at {at} is cut short")
    n = int.from_bytes(data[at : at + width], "big")
    value = n & (1 << 7 * width) - 1
    return (n if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its body starts, where it ends) of the elements from ``at`` to ``end``.

    A master of unknown size reaches to the next element of its own or a higher level, here: to ``end`` for a segment
    and to the next cluster or cues for a cluster.
    """
    while at < end:
        n, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body)
        if unknown and n == CLUSTER:
            stop = body
            while stop < end:
                child, b, _ = vint(data, stop, True)
                if child in (CLUSTER, CUES, INFO, TRACKS):
                    break
                more, b, _ = vint(data, b)
                stop = b + more
        else:
            stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"element at {at} reaches past its parent")
        yield n, at, body, stop
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, lacing, [(at, length) of each frame]) of a block's body."""
    track, at, _ = vint(data, at)
    offset, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if not lacing:
        return track, offset, flags, lacing, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        sizes = []
        for _ in range(count - 1):
            size = 0
            while True:
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    else:
        size, at, _ = vint(data, at)
        sizes = [size]
        for _ in range(count - 2):
            start = at
            diff, at, _ = vint(data, at)
            size += diff - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, offset, flags, lacing, out


def packets(data: bytes) -> tuple[list[tuple], str | None]:
    """The packet table: (track, timestamp ns, at, length, cluster's at, keyframe, lacing, cluster has a cue), and what
    ended the parse, if it didn't reach the end.  Packets before a fault are kept."""
    found, cues, durations, scale, problem = [], set(), {}, 1_000_000, None

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    try:
        for n, _, body, end in elements(data, 0, len(data)):
            if n != SEGMENT:
                continue
            segment = body
            for m, start, a, b in elements(data, body, end):
                if m == INFO:
                    scale = next((uint(x, y) for k, _, x, y in elements(data, a, b) if k == TIMESTAMP_SCALE), scale)
                elif m == TRACKS:
                    for k, _, x, y in elements(data, a, b):
                        if k == TRACK_ENTRY:
                            entry = {j: uint(p, q) for j, _, p, q in elements(data, x, y) if j in (TRACK_NUMBER, DEFAULT_DURATION)}
                            durations[entry.get(TRACK_NUMBER)] = entry.get(DEFAULT_DURATION, 0)
                elif m == CLUSTER:
                    base = 0
                    for k, _, x, y in elements(data, a, b):
                        if k == CLUSTER_TIMESTAMP:
                            base = uint(x, y)
                            continue
                        blocks = [(x, y, k)] if k == SIMPLE_BLOCK else [(p, q, j) for j, _, p, q in elements(data, x, y) if j == BLOCK] if k == BLOCK_GROUP else []
                        for p, q, j in blocks:
                            track, offset, flags, lacing, parts = frames(data, p, q)
                            t, step, key = (base + offset) * scale, durations.get(track, 0), j == SIMPLE_BLOCK and flags >= 128
                            found += [(track, t + i * step, f, size, start, key, lacing) for i, (f, size) in enumerate(parts)]
                elif m == CUES:
                    for k, _, x, y in elements(data, a, b):
                        for j, _, p, q in elements(data, x, y) if k == CUE_POINT else ():
                            if j == CUE_TRACK_POSITIONS:
                                cues |= {segment + uint(u, v) for i, _, u, v in elements(data, p, q) if i == CUE_CLUSTER_POSITION}
    except (ValueError, IndexError, struct.error) as e:
        problem = str(e)
    return [(*f[:6], LACINGS[f[6]], f[4] in cues) for f in found], problem


def packet_table(media: DataFrame) -> DataFrame:
    """One row a packet of (doc_id, media) rows.

    Null or empty media have no packets; a file that breaks off gives the packets before the fault, the last with
    ``problem``, or one row of nulls with ``problem``; other columns are ignored.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        for b in batches:
            for i, data in zip(b["doc_id"], b["media"], strict=True):
                found, problem = packets(bytes(data or b""))
                table = [(i, n, *f, None) for n, f in enumerate(found)]
                if problem:
                    table = [*table[:-1], (*table[-1][:-1], problem)] if table else [(i, *[None] * 9, problem)]
                for at in range(0, len(table), 10_000):
                    yield pd.DataFrame(table[at : at + 10_000], columns=names, dtype=object)

    return media.select(F.col("doc_id").cast("long"), "media").mapInPandas(rows, PACKETS)


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data)), len(data)


def mux_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, media) with each whole text, null as empty, as the samples of a Matroska file.

    Equal texts give equal files, so repeated rows are alike; an empty table gives no rows; null ids stay null; other columns are
    left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "media": [mux(padded(t)[0]) for t in part["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(rows, "doc_id long, media binary")


def digest(media: bytes) -> tuple:
    """(payload, feature, packets, clusters, cued clusters, duration in ms) from the stored bytes.

    The feature tells the packet table and the sound's coarse shape: for each eighth of the samples their mean.
    """
    table, problem = packets(media)
    if problem:
        raise ValueError(problem)
    view = memoryview(media)
    payload = b"".join([view[f[2] : f[2] + f[3]] for f in table])
    clusters = {f[4]: f[7] for f in table}
    step = max(1, -(-len(payload) // 8))
    shape = [sum(payload[i : i + step]) // max(1, len(payload[i : i + step])) for i in range(0, len(payload), step)]
    times = array("q", [f[1] for f in table])
    stamp = zlib.crc32(times.tobytes())
    duration = table[-1][1] // 1_000_000 + UNIT * 1000 // RATE if table else 0
    text = f"packets={len(table)};clusters={len(clusters)};cues={sum(clusters.values())};ms={duration};times={stamp:08x};shape={','.join(map(str, shape))}"
    return payload, text, len(table), len(clusters), sum(clusters.values()), duration


def digests(media: DataFrame) -> DataFrame:
    """Sizes, hashes and features of (doc_id, media) rows, from the stored bytes; one row a row of ``media``.

    Null or empty media have an empty payload and no packets; a file that breaks off raises; other columns are ignored.
    Padding bytes are no UTF-8, so the payload tells where its text ends.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for b in batches:
            out = []
            for i, media in zip(b["doc_id"], b["media"], strict=True):
                media = bytes(media or b"")
                payload, feature, *rest = digest(media)
                n = len(payload.rstrip(b"\xff"))
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, *rest))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return media.select(F.col("doc_id").cast("long"), "media").mapInPandas(rows, DIGEST)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text of ``docs`` as a Matroska file in a media column, read the column back and return its digests.

    Null texts are empty; null doc_ids stay null; repeated rows are stored each; an empty table gives no rows; other columns
    are ignored.
    """
    return digests(written(mux_documents(docs), "media"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))
