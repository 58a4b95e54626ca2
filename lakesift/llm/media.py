"""Matroska files in binary columns: writing 8-bit samples and parsing files into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import small_batches, text_of
from lakesift.llm.vocabulary import slices

# Fixed values of the Matroska and EBML specifications (RFC 8794, RFC 9559): element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
#: Elements of unknown size end before an element that can't lie in them: children of a segment end a cluster.
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

FRAME = 576  # samples of 8 bits: 12 ms at 48 kHz
FRAME_MS = 12
LACED = 8  # frames in a block
CLUSTER_FRAMES = 512  # 6.144 s: below the 16 bits of a block's relative time


class Packet(NamedTuple):
    """A frame: track, nanoseconds, byte range in the file, cluster, block, key frame."""

    track: int
    timestamp: int
    begin: int
    end: int
    cluster: int
    block: int
    key: bool


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]  # nanoseconds, track, file position of the cluster
    clusters: list[int]  # their file positions
    duration: float | None  # nanoseconds


# ------------------------------------------------------------------------------- writing
def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:  # all ones means "unknown"
        width += 1
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2)]))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, b"".join([
    _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000), _element(CODEC_ID, b"A_PCM/INT/LIT"),
    _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", 48000.0)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
])))


def lace(frames: list[bytes], track: int, relative: int, lacing: int, key: bool = True) -> bytes:
    """The body of a SimpleBlock."""
    head = _size(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in frames[:-1])
    elif lacing == EBML_LACING:
        head += _size(len(frames[0]))
        for before, x in zip(frames, frames[1:-1], strict=False):
            diff, width = len(x) - len(before), 1
            while abs(diff) > (1 << (7 * width - 1)) - 1:
                width += 1
            head += ((1 << (7 * width)) | (diff + (1 << (7 * width - 1)) - 1)).to_bytes(width, "big")
    elif len({len(x) for x in frames}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def padded(content: bytes) -> bytes:
    """``content`` and bytes 255 up to a positive multiple of ``FRAME``."""
    return content + b"\xff" * (max(FRAME, -(-len(content) // FRAME) * FRAME) - len(content))


def write_samples(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit samples; equal payloads give equal files."""
    frames = len(payload) // FRAME
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"lakesift") + _element(WRITING_APP, b"lakesift") + _element(DURATION, struct.pack(">d", float(frames * FRAME_MS))))
    body, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, CLUSTER_FRAMES):
        blocks = [_uint(TIMESTAMP, first * FRAME_MS)]
        for k in range(first, min(frames, first + CLUSTER_FRAMES), LACED):
            group = [payload[j * FRAME:(j + 1) * FRAME] for j in range(k, min(frames, first + CLUSTER_FRAMES, k + LACED))]
            blocks.append(_element(SIMPLE_BLOCK, lace(group, 1, (k - first) * FRAME_MS, FIXED_LACING if len(group) > 1 else NO_LACING)))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


# ------------------------------------------------------------------------------- parsing
def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length number and the place after it; None is the reserved "unknown" size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad EBML number at {at}")
    value = int.from_bytes(data[at:at + width], "big")
    if not keep_marker:
        value &= (1 << (7 * width)) - 1
        if value == (1 << (7 * width)) - 1:
            return None, at + width
    return value, at + width


_TOP = {EBML, SEGMENT}
_OF_SEGMENT = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of each element's body in ``data[at:end]``."""
    for _, kind, begin, stop in placed(data, at, end):
        yield kind, begin, stop


def placed(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(place of the id, id, begin, end) of each element. One of unknown size ends where its parent ends, or before the first
    element that can't be its child: for a cluster any child of a segment, for a segment another header or segment."""
    while at < end:
        head = at
        kind, at = _vint(data, at, True)
        n, at = _vint(data, at, False)
        stop = _end_of_unknown(data, kind, at, end) if n is None else at + n
        if stop > end:
            raise ValueError(f"element {kind:x} exceeds its parent")
        yield head, kind, at, stop
        at = stop


def _end_of_unknown(data: bytes, kind: int, at: int, end: int) -> int:
    strangers = _TOP if kind == SEGMENT else _TOP | _OF_SEGMENT
    while at < end:
        inner, after = _vint(data, at, True)
        if inner in strangers:
            return at
        n, after = _vint(data, after, False)
        at = _end_of_unknown(data, inner, after, end) if n is None else after + n
    return at


def _number(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def _float(data: bytes, begin: int, end: int) -> float:
    return struct.unpack(">f" if end - begin == 4 else ">d", data[begin:end])[0]


def frames_of(data: bytes, begin: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, key flag and the byte ranges of the frames of a block."""
    track, at = _vint(data, begin, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, bool(flags & 0x80), [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH_LACING:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING and n > 1:
        size, at = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw, at = _vint(data, at, True)
            sizes.append(sizes[-1] + (raw & (1 << (7 * width)) - 1) - ((1 << (7 * width - 1)) - 1))
    elif lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // n] * (n - 1)
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    if at > end or any(b < a for a, b in ranges):
        raise ValueError("laced frames exceed their block")
    return track, relative, bool(flags & 0x80), [*ranges, (at, end)]


def parse(data: bytes) -> Parsed:
    """Packets, tracks, cues and clusters of a Matroska file. A damaged file raises ValueError."""
    out = Parsed([], {}, [], [], None)
    try:
        top = list(elements(data, 0, len(data)))
        if not top or top[0][0] != EBML:
            raise ValueError("no EBML header")
        for kind, begin, end in top:
            if kind == SEGMENT:
                out = _segment(data, begin, end, out)
    except (IndexError, struct.error) as e:
        raise ValueError(f"damaged file: {e}") from e
    return out


def _segment(data: bytes, begin: int, end: int, out: Parsed) -> Parsed:
    duration, scale = out.duration, 1_000_000
    for head, kind, a, b in placed(data, begin, end):
        if kind == INFO:
            info = {k: (x, y) for k, x, y in elements(data, a, b)}
            if TIMESTAMP_SCALE in info:
                scale = _number(data, *info[TIMESTAMP_SCALE])
            if DURATION in info:
                duration = _float(data, *info[DURATION]) * scale
        elif kind == TRACKS:
            for k, x, y in elements(data, a, b):
                if k == TRACK_ENTRY:
                    own = {c: (s, e) for c, s, e in elements(data, x, y)}
                    audio = {c: (s, e) for c, s, e in elements(data, *own[AUDIO])} if AUDIO in own else {}
                    out.tracks[_number(data, *own[TRACK_NUMBER])] = {
                        "type": _number(data, *own[TRACK_TYPE]), "codec": data[slice(*own[CODEC_ID])].decode("ascii"),
                        "frame_ns": _number(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                        "rate": _float(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 0.0, "bits": _number(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0,
                    }
        elif kind == CLUSTER:
            _cluster(data, a, b, scale, out)
            out.clusters.append(head)
        elif kind == CUES:
            for k, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    own = list(elements(data, x, y))
                    time = next(_number(data, s, e) for c, s, e in own if c == CUE_TIME)
                    for c, s, e in own:
                        if c == CUE_TRACK_POSITIONS:
                            place = {i: _number(data, p, q) for i, p, q in elements(data, s, e)}
                            out.cues.append((time * scale, place[CUE_TRACK], begin + place[CUE_CLUSTER_POSITION]))
    return out._replace(duration=duration)


def _cluster(data: bytes, a: int, b: int, scale: int, out: Parsed) -> None:
    time, n, block = 0, len(out.clusters), out.packets[-1].block + 1 if out.packets else 0
    for kind, x, y in elements(data, a, b):
        if kind == TIMESTAMP:
            time = _number(data, x, y)
            continue
        inner = [(x, y)] if kind == SIMPLE_BLOCK else [(s, e) for c, s, e in elements(data, x, y) if c == BLOCK] if kind == BLOCK_GROUP else []
        for s, e in inner:
            track, relative, key, ranges = frames_of(data, s, e)
            step = out.tracks.get(track, {}).get("frame_ns", 0)
            out.packets.extend(Packet(track, (time + relative) * scale + i * step, p, q, n, block, key) for i, (p, q) in enumerate(ranges))
            block += 1


# ------------------------------------------------------------------------------- columns
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, "content")):
        raw = [(x or "").encode() for x in part.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_samples(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text, padded, as a Matroska file. A null text is an empty one."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("content")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, packet int, track int, timestamp_ns long, byte_from long, byte_to long, cluster int, block int, key boolean"


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, "media")):
        for doc, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
            rows = [(doc, i, p.track, p.timestamp, p.begin, p.end, p.cluster, p.block, p.key) for i, p in enumerate(parse(data).packets)] if data is not None else []
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of each file of the ``media`` column; a null file has none."""
    return media.select("doc_id", "media").mapInArrow(_packets, PACKETS)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, "media")):
        rows = []
        for doc, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            file = parse(data)
            payload = b"".join([data[p.begin:p.end] for p in file.packets])
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(file, payload)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 3 + (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], [x.split()[0] for x in READ.split(", ")])


def feature(file: Parsed, payload: bytes) -> str:
    """Counts of the packet table and moments of the samples, as text."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    clusters = set(file.clusters)
    seekable = sum(place in clusters for _, _, place in file.cues)
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
    return f"tracks={len(file.tracks)};packets={len(file.packets)};clusters={len(file.clusters)};cues={seekable};ms={int(file.duration or 0) // 1_000_000};sum={int(samples.sum(dtype=np.int64))};steps={steps};distinct={int(np.count_nonzero(np.bincount(samples, minlength=256)))}"


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of each stored file, from its packets' byte ranges.

    Empty text: one frame of bytes 255. Equal texts: equal files and values. Empty table: empty
    result. Only doc_id, n_bytes and media are read.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)
