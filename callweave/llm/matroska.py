"""Media columns: Matroska files written, and parsed into packet tables.

``mux`` stores bytes as an 8-bit PCM audio track. ``demux`` walks the variable-length EBML elements
of any Matroska file: header, segment, info, tracks, clusters with simple blocks and block groups
(no, Xiph, EBML and fixed-size lacing) and cues, into one row per frame: cluster, track, timestamp,
key flag, byte offset and size in the file. Elements of unknown size end where a parent or sibling
begins; void, checksum and unknown elements are skipped. A broken or cut file gives the packets
before the break and an error text, never an exception.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, frugal, table, text_or_empty

# Element ids of the public Matroska specification (fixed values).
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOCTYPE_VERSION, DOCTYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
MUXING_APP, WRITING_APP, FLAG_LACING = 0x4D80, 0x5741, 0x9C
EBML, EBML_DOCTYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}

RATE = 8000
FRAME = 512
LACE = 8
BLOCKS_IN_CLUSTER = 8
ALIGN = 64

#: Bytes of payload after which a task hands its rows on.
FLUSH_BYTES = 4 << 20

PACKET = "array<struct<cluster:int,track:int,timestamp:long,key:boolean,offset:long,size:long>>"


def _vint(n: int) -> bytes:
    size = 1
    while n >= (1 << 7 * size) - 1:
        size += 1
    return (n | 1 << 7 * size).to_bytes(size, "big")


def _element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(code: int, n: int) -> bytes:
    return _element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A simple block: fixed-size lacing for equal frames, EBML lacing for unequal ones."""
    head = _vint(track) + struct.pack(">h", relative)
    if len(frames) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return _element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    lace = _vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        size = 1
        while not -(1 << 7 * size - 1) < b - a < 1 << 7 * size - 1:
            size += 1
        lace += (b - a + (1 << 7 * size - 1) - 1 | 1 << 7 * size).to_bytes(size, "big")
    return _element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """One 8-bit mono PCM track at 8000 Hz; a timestamp unit is one sample. All mandatory elements are written."""
    kind = _element(EBML_DOCTYPE, b"matroska") + _uint(DOCTYPE_VERSION, 4) + _uint(DOCTYPE_READ_VERSION, 2)
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + kind)
    made_by = _element(MUXING_APP, b"callweave") + _element(WRITING_APP, b"callweave")
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000_000 // RATE) + _element(DURATION, struct.pack(">d", len(payload))) + made_by)
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    step = FRAME * LACE
    for start in range(0, len(payload), step * BLOCKS_IN_CLUSTER):
        body = [_uint(TIMESTAMP, start)]
        for b in range(start, min(len(payload), start + step * BLOCKS_IN_CLUSTER), step):
            block = payload[b : b + step]
            body.append(_block(1, b - start, [block[i : i + FRAME] for i in range(0, len(block), FRAME)]))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


def _read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, next position and width; ``keep`` leaves the length marker in, as ids have it."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad integer at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep else n & (1 << 7 * width) - 1), at + width, width


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags, and (offset, size) of each frame of a block."""
    track, at, _ = _read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3 and n > 1:
        size, at, _ = _read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            d, at, width = _read_vint(data, at)
            size += d - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    elif lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"bad lacing at {at}")
    starts = np.cumsum([at, *sizes]).tolist()
    return track, relative, flags, list(zip(starts, sizes, strict=False))


def demux(data: bytes | None) -> dict:
    """Packets, tracks, cues (time, track, cluster position) and an error text, null for a whole file.

    A laced frame's timestamp is its block's plus what the frames before it last: a sample a byte for
    8-bit mono PCM, else the block's own.
    """
    out = {"packets": [], "tracks": [], "cues": [], "clusters": 0, "scale": 1_000_000, "error": None}
    if not data:
        return out | {"error": "empty"}
    state = {"base": 0, "cue": {}, "track": {}}
    try:
        _walk(data, 0, len(data), out, state, 0)
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def _walk(data: bytes, at: int, end: int, out: dict, state: dict, parent: int) -> int:
    while at < end:
        begin = at
        code, at, _ = _read_vint(data, at, keep=True)
        if parent == CLUSTER and state.get("open") and code in _TOP | {EBML, SEGMENT}:
            return begin  # an open-ended cluster ends here
        size, at, width = _read_vint(data, at)
        unknown = size == (1 << 7 * width) - 1
        if unknown and code not in (SEGMENT, CLUSTER):
            raise ValueError(f"unknown size at {begin}")
        stop = end if unknown else at + size
        if stop > end:
            if code not in _MASTERS:
                raise ValueError(f"cut at {begin}")
            out["error"], stop = f"cut at {begin}", end
        if code in _MASTERS:
            if code == CLUSTER:
                out["clusters"] += 1
                state |= {"base": 0, "open": unknown}
            elif code == TRACK_ENTRY:
                state["track"] = {}
            elif code == CUE_POINT:
                state["cue"] = {}
            group = len(out["packets"])
            if code == BLOCK_GROUP:
                state["refers"] = False
            at = _walk(data, at, stop, out, state, code)
            if code == TRACK_ENTRY:
                out["tracks"].append(state["track"])
            elif code == CUE_TRACK_POSITIONS:
                out["cues"].append((state["cue"].get(CUE_TIME, 0), state["cue"].get(CUE_TRACK, 0), state["cue"].get(CUE_CLUSTER_POSITION, 0)))
            elif code == BLOCK_GROUP and state["refers"]:
                out["packets"][group:] = [(*p[:3], False, *p[4:]) for p in out["packets"][group:]]
            continue
        value = data[at:stop] if code not in (SIMPLE_BLOCK, BLOCK) else b""
        if code == TIMESTAMP and parent == CLUSTER:
            state["base"] = int.from_bytes(value, "big")
        elif code == TIMESTAMP_SCALE:
            out["scale"] = int.from_bytes(value, "big")
        elif code in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH):
            state["track"][code] = int.from_bytes(value, "big")
        elif code == CODEC_ID:
            state["track"][code] = value.rstrip(b"\0").decode("ascii", "replace")
        elif code == SAMPLING:
            state["track"][code] = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
        elif code in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            state["cue"][code] = int.from_bytes(value, "big")
        elif code == REFERENCE_BLOCK:
            state["refers"] = True
        elif code in (SIMPLE_BLOCK, BLOCK):
            track, relative, flags, frames = _frames(data, at, stop)
            pcm = any(t.get(TRACK_NUMBER) == track and t.get(BIT_DEPTH) == 8 and t.get(CHANNELS, 1) == 1 for t in out["tracks"])
            time, key = state["base"] + relative, bool(flags & 0x80) or code == BLOCK
            for offset, n in frames:
                out["packets"].append((out["clusters"] - 1, track, time, key, offset, n))
                time += n if pcm else 0
        at = stop
    return at


def payload_of(text: str) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes filled up with zeros to a positive multiple of 64."""
    raw = text.encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ALIGN)) * ALIGN, b"\0")


def feature_of(payload: bytes, found: dict) -> str:
    """Counts of the container, and mean, root mean square and zero crossings of the centred samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = max(1, len(samples))
    above = samples >= 128
    crossings = int((above[1:] != above[:-1]).sum())
    mean, square = int(samples.sum()) * 1000 // n, int((samples * samples).sum()) // n
    return f"clusters={found['clusters']};packets={len(found['packets'])};cues={len(found['cues'])};mean={mean};ms={square};cross={crossings}"


def _parts(values: list) -> Iterator[list]:
    """Runs of values of about ``FLUSH_BYTES``."""
    held, part = 0, []
    for v in values:
        part.append(v)
        held += len(v) if v is not None else 0
        if held > FLUSH_BYTES:
            yield part
            held, part = 0, []
    if part:
        yield part


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``media``: n_bytes and the Matroska file ``data``.

    Null and empty texts have 0 bytes and a file of ``ALIGN`` zero samples. Texts are stored whole, whatever their length.
    """

    @F.pandas_udf("n_bytes long, data binary")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for part in _parts(texts.tolist()):
                rows = [(n, mux(p)) for n, p in (payload_of(t if isinstance(t, str) else "") for t in part)]
                yield pd.DataFrame(rows, columns=["n_bytes", "data"])

    return docs.withColumn(free_name(docs, "media"), run(text_or_empty(text)))


def read_media(files: DataFrame, data: str) -> DataFrame:
    """``files`` with a struct column ``demuxed``: packets, payload (all frames of the first track), feature, error.

    Null or empty files have no packets and the error ``empty``.
    """

    @F.pandas_udf(f"packets {PACKET}, payload binary, tail_crc32 long, feature string, error string")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in (part for batch in batches for part in _parts(batch.tolist())):
            rows = []
            for raw in raws:
                found = demux(raw)
                track = found["tracks"][0].get(TRACK_NUMBER) if found["tracks"] else None
                payload = b"".join([raw[p[4] : p[4] + p[5]] for p in found["packets"] if p[1] == track])
                packets = [dict(zip(("cluster", "track", "timestamp", "key", "offset", "size"), p, strict=True)) for p in found["packets"]]
                rows.append((packets, payload, zlib.crc32(payload[-ALIGN:]), feature_of(payload, found), found["error"]))
            yield pd.DataFrame(rows, columns=["packets", "payload", "tail_crc32", "feature", "error"])

    return files.withColumn(free_name(files, "demuxed"), run(F.col(data)))


def packet_table(files: DataFrame, data: str, key: str) -> DataFrame:
    """One row per frame: the key, cluster, track, timestamp, key flag, byte offset and size."""
    return read_media(files.select(F.col(key), F.col(data).alias("data")), "data").select(key, F.inline("demuxed.packets"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a Matroska file and read back; null texts are empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = read_media(store_texts(docs).select("doc_id", F.col("media.n_bytes").alias("n_bytes"), F.col("media.data").alias("data")), "data")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("demuxed.payload").cast("long").alias("payload_bytes"),
        F.sha2("demuxed.payload", 256).alias("payload_sha256"),
        "demuxed.tail_crc32",
        F.octet_length("data").cast("long").alias("media_bytes"),
        F.sha2("data", 256).alias("media_sha256"),
        "demuxed.feature",
    )
