"""Operator 10: media columns of MPEG audio.

Payload bytes are stored losslessly in MPEG-1 layer III streams: an ID3v2 tag, a frame with a
variable-bitrate table (Xing: frames, bytes, 100 seek points), and frames that carry a checksum, empty
side information and payload as ancillary data, so they play as silence. The reader does not rely on
the writer: it reads tags (ID3v1, ID3v2.2 to 2.4), looks for frame headers and resynchronises after foreign bytes,
checks the CRC-16 of every frame of layers I to III that has one, reads the variable-bitrate table (Xing or VBRI), and
gives exact durations (samples over sampling rate), the seek offset of every frame and the table's seek points.

Cases: null text counts as empty, whose payload is 64 zero bytes; bytes that hold no frame give an
empty index with zero duration; frames with a wrong checksum are counted and their payload is left
out; equal texts give equal media; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waylake.llm.common import materialise

# fixed values of the MPEG audio format: bitrates in kbit/s by index, sampling rates in Hz by index
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
# fixed values too: bits of the allocation of each subband in layer II, as (bits, subbands)
WIDTHS = ((4, 11), (3, 12), (2, 7))  # version 1
WIDTHS_LOW_RATE = ((4, 2), (3, 10))  # version 1 under 56 kbit/s a channel
WIDTHS_HALF_RATE = ((4, 4), (3, 7), (2, 19))  # versions 2 and 2.5

_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _CRC.append(_c & 0xFFFF)


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    for b in data:
        start = (start << 8 & 0xFFFF) ^ _CRC[start >> 8 ^ b]
    return start


def crc16_of_bits(head: bytes, data: bytes, n_bits: int) -> int:
    """The checksum of ``head`` and of the first bits of ``data``."""
    whole, rest = divmod(n_bits, 8)
    crc = crc16(data[:whole], crc16(head))
    for k in range(rest):
        bit = data[whole] >> 7 - k & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc


@dataclass(frozen=True)
class Header:
    """One frame header; ``length`` is the whole frame's."""

    version: float
    layer: int
    has_crc: bool
    bitrate: int
    rate: int
    channels: int
    length: int
    samples: int
    side: int  # bytes of side information (layer III)

    @property
    def key(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    if four not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[four] = _parse_header(four)
    return _headers[four]


def _parse_header(four: bytes) -> Header | None:
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    table = 1 if version == 1 else 2
    bitrate, rate = BITRATES[table, layer][index], RATES[version][rate_index]
    samples = SAMPLES[table, layer]
    if layer == 1:
        length = (12000 * bitrate // rate + padding) * 4
    else:
        length = samples // 8 * 1000 * bitrate // rate + padding
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}[table, mono]
    return Header(version, layer, not four[1] & 1, bitrate, rate, 2 - mono, length, samples, side)


def _allocation_widths(head: Header) -> list[int]:
    if head.layer == 1:
        return [4] * 32
    if head.version != 1:
        table, n = WIDTHS_HALF_RATE, 30
    elif (each := head.bitrate // head.channels) < 56:
        table, n = WIDTHS_LOW_RATE, 12 if head.rate == 32000 else 8
    else:
        table, n = WIDTHS, 30 if each >= 96 and head.rate != 48000 else 27
    return [bits for bits, bands in table for _ in range(bands)][:n]


def protected_bits(frame: bytes, head: Header) -> int:
    """How many bits after the checksum it covers: the side information of layer III; in layers I and II the bit
    allocation, and in layer II which scale factors follow, 2 bits for each allocated subband of a channel."""
    if head.layer == 3:
        return 8 * head.side
    joint, extension = frame[3] >> 6 == 1, frame[3] >> 4 & 3
    widths = _allocation_widths(head)
    bound = 4 * (extension + 1) if joint else 32  # subbands from here on share one allocation
    after = frame[6:46].ljust(40, b"\0")  # 308 bits at most
    field, used, allocated = int.from_bytes(after, "big"), 0, 0
    for band, width in enumerate(widths):
        own = head.channels if band < bound else 1
        for _ in range(own):
            used += width
            allocated += (head.channels // own) * bool(field >> 320 - used & (1 << width) - 1)
    return used + 2 * allocated * (head.layer == 2)


# writing

RATE_INDEX = 1  # 48 kHz: frame lengths need no padding bits


def _frame_head(bitrate_index: int) -> bytes:
    head = bytes([0xFF, 0xFA, bitrate_index << 4 | RATE_INDEX << 2, 0x00])  # layer III, checksum, stereo
    return head + crc16(head[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


FRAME_HEADS = {i: _frame_head(i) for i in range(1, 15)}
ROOM = {i: parse_header(h[:4]).length - len(h) for i, h in FRAME_HEADS.items()}  # type: ignore[union-attr]
FULL = 14  # the largest frames, 320 kbit/s


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3_tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of user-defined text frames."""
    frames = b""
    for name, value in fields.items():
        body = b"\x00" + name.encode("latin-1") + b"\x00" + value.encode("latin-1")
        frames += b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3\x03\x00\x00" + _synchsafe(len(frames)) + frames


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """A stream whose frames carry the payload; the tag keeps its length and the unpadded length."""
    full, rest = divmod(len(payload), ROOM[FULL])
    frames = np.zeros((full, len(FRAME_HEADS[FULL]) + ROOM[FULL]), np.uint8)
    frames[:, : len(FRAME_HEADS[FULL])] = np.frombuffer(FRAME_HEADS[FULL], np.uint8)
    frames[:, len(FRAME_HEADS[FULL]) :] = np.frombuffer(payload, np.uint8, full * ROOM[FULL]).reshape(full, ROOM[FULL])
    body = frames.tobytes()
    lengths = [frames.shape[1]] * full
    if rest:
        index = min((i for i in ROOM if ROOM[i] >= rest), key=ROOM.get)  # type: ignore[arg-type]
        last = FRAME_HEADS[index] + payload[len(payload) - rest :] + bytes(ROOM[index] - rest)
        body += last
        lengths.append(len(last))
    count = len(lengths)
    table_length = len(FRAME_HEADS[9]) + ROOM[9]
    total = table_length + len(body)
    ends = np.cumsum([table_length, *lengths[:-1]]) if count else np.array([table_length])
    seek = bytes(min(255, int(ends[min(count - 1, i * count // 100)]) * 256 // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    table = FRAME_HEADS[9] + xing
    table += bytes(table_length - len(table))
    return id3_tag({"payload_bytes": str(len(payload)), "n_bytes": str(n_bytes)}) + table + body


# reading


@dataclass
class Stream:
    """What is known of a stream after reading it."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of every audio frame
    samples: int = 0
    by_rate: dict[int, int] = field(default_factory=dict)  # samples of frames of each rate
    rate: int = 0
    channels: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes passed over while looking for a header
    table_frames: int = -1  # as the variable-bitrate table says
    table_bytes: int = -1
    seek: bytes = b""
    seek_points: list[int] = field(default_factory=list)  # bytes from the table's frame, at equal steps of time
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> float:
        """Seconds, each frame's samples by its own rate."""
        return float(sum((Fraction(n, rate) for rate, n in self.by_rate.items()), Fraction(0)))

    @property
    def payload(self) -> bytes:
        whole = b"".join(self.ancillary)
        n = self.tags.get("payload_bytes", "")
        return whole[: int(n)] if n.isdigit() else whole


def _seven_bits(data: bytes) -> int:
    n = 0
    for b in data:
        n = n << 7 | b & 0x7F
    return n


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")  # by the first byte of a text frame


def _texts(body: bytes) -> list[str]:
    """The texts of a text frame, which zero characters separate."""
    if not body or body[0] >= len(ENCODINGS):
        return []
    text = body[1:].decode(ENCODINGS[body[0]], "replace")
    return [t.removeprefix("\ufeff") for t in text.rstrip("\0").split("\0")]


def _read_id3v2(data: bytes, at: int, stream: Stream) -> int:
    """Position after the tag that starts here. Reads versions 2.2 to 2.4 with extended headers, unsynchronisation and footers."""
    version, flags = data[at + 3], data[at + 5]
    size = _seven_bits(data[at + 6 : at + 10])
    stop = min(at + 10 + size + (10 if version >= 4 and flags & 0x10 else 0), len(data))
    body = data[at + 10 : at + 10 + size]
    whole_tag = bool(flags & 0x80)
    if whole_tag and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    i = 0
    if flags & 0x40 and version >= 3:  # the size counts itself since 2.4
        i = _seven_bits(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if version == 2 else 10
    while version >= 2 and i + head <= len(body) and body[i]:
        name = body[i : i + (3 if version == 2 else 4)]
        if version == 2:
            n, form = int.from_bytes(body[i + 3 : i + 6], "big"), 0
        else:
            n = _seven_bits(body[i + 4 : i + 8]) if version >= 4 else int.from_bytes(body[i + 4 : i + 8], "big")
            form = body[i + 9]
        frame = body[i + head : i + head + n]
        i += head + n
        if version >= 4:
            if form & 0x02 or whole_tag:
                frame = frame.replace(b"\xff\x00", b"\xff")
            frame = frame[(form >> 6 & 1) + 4 * (form & 1) :]  # a group's number and the length of the data
            hidden = form & 0x0C
        else:
            hidden = form & 0xC0
            frame = frame[form >> 5 & 1 :] if version == 3 else frame
        if hidden or name[:1] != b"T":  # compressed, encrypted or no text
            continue
        texts = _texts(frame)
        if name in (b"TXXX", b"TXX"):
            if len(texts) > 1:
                stream.tags[texts[0]] = texts[1]
        elif texts:
            stream.tags[name.decode("latin-1")] = texts[0]
    return stop


def _read_table(data: bytes, at: int, head: Header, stream: Stream) -> bool:
    """Whether the first frame holds a variable-bitrate table, which is read."""
    i = at + 4 + 2 * head.has_crc + head.side
    if data[i : i + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[i + 4 : i + 8], "big")
        i += 8
        if flags & 1:
            stream.table_frames = int.from_bytes(data[i : i + 4], "big")
            i += 4
        if flags & 2:
            stream.table_bytes = int.from_bytes(data[i : i + 4], "big")
            i += 4
        if flags & 4:
            stream.seek = data[i : i + 100]
            stream.seek_points = [s * max(stream.table_bytes, 0) // 256 for s in stream.seek]
        return True
    i = at + 36
    if data[i : i + 4] == b"VBRI":
        stream.table_bytes = int.from_bytes(data[i + 10 : i + 14], "big")
        stream.table_frames = int.from_bytes(data[i + 14 : i + 18], "big")
        entries, scale, width = (int.from_bytes(data[i + k : i + k + 2], "big") for k in (18, 20, 22))
        # one entry for so many frames: the bytes that they take
        table = data[i + 26 : min(i + 26 + entries * width, at + head.length)]
        position, points = 0, []
        for k in range(0, len(table) - width + 1, width) if width else ():
            points.append(position)
            position += int.from_bytes(table[k : k + width], "big") * scale
        stream.seek_points = points
        return True
    return False


def _synchronised(data: bytes, at: int, known: Header | None) -> Header | None:
    """The header here, if the next one agrees with it, the data ends after it, or it continues the stream."""
    head = parse_header(data[at : at + 4])
    if head is None or at + head.length > len(data):
        return None
    if known is not None and head.key == known.key:
        return head
    after = at + head.length
    following = parse_header(data[after : after + 4])
    if after == len(data) or data[after : after + 3] == b"TAG" or following is not None and following.key == head.key:
        return head
    return None


def read_stream(data: bytes) -> Stream:
    stream, at, known = Stream(), 0, None
    crc_cache: dict[tuple[int, bytes, bytes], int] = {}
    while at < len(data):
        if data[at : at + 3] == b"ID3" and len(data) >= at + 10:
            at = _read_id3v2(data, at, stream)
            continue
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:  # ID3v1
            for name, i, j in (("title", 3, 33), ("artist", 33, 63)):
                stream.tags[name] = data[at + i : at + j].rstrip(b"\x00 ").decode("latin-1")
            break
        head = _synchronised(data, at, known)
        if head is None:
            found = data.find(b"\xff", at + 1)
            found = len(data) if found < 0 else found
            for mark in (b"TAG", b"ID3"):
                other = data.find(mark, at + 1, found)
                found = other if other >= 0 else found
            stream.skipped += found - at
            at, known = found, None
            continue
        if known is None and not stream.offsets and stream.table_frames < 0:
            if _read_table(data, at, head, stream):
                known, at = head, at + head.length
                continue
        known = head
        good, start = True, at + 4
        if head.has_crc:
            n_bits = protected_bits(data[at : at + 46], head) if head.layer < 3 else 8 * head.side
            covered = n_bits, data[at + 2 : at + 4], data[at + 6 : at + 6 + -(-n_bits // 8)]
            want = crc_cache.get(covered)
            if want is None:
                if len(crc_cache) > 1000:
                    crc_cache.clear()
                want = crc_cache[covered] = crc16_of_bits(covered[1], covered[2].ljust(-(-n_bits // 8), b"\0"), n_bits)
            good = want == int.from_bytes(data[at + 4 : at + 6], "big")
            stream.crc_ok += good
            stream.crc_bad += not good
            start += 2
        stream.offsets.append(at)
        stream.samples += head.samples
        stream.by_rate[head.rate] = stream.by_rate.get(head.rate, 0) + head.samples
        stream.rate, stream.channels = head.rate, head.channels
        if good:
            stream.ancillary.append(data[start + head.side : at + head.length])
        at += head.length
    return stream


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text as the payload of an MPEG audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                media = [write_stream(*padded(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, media binary")


INDEX = "doc_id long, tags map<string,string>, rate int, channels int, n_frames long, n_samples long, duration double, crc_ok long, crc_bad long, skipped_bytes long, table_frames long, frame_offsets array<long>, seek_points array<long>"


def index_media(media: DataFrame) -> DataFrame:
    """Tags, exact duration, checksum counts and frame seek offsets of every stream in (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in INDEX.split(", ")]
        kinds = [pa.int64(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), *[pa.int64()] * 2, pa.float64(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = read_stream(data or b"")
                rows.append((doc_id, list(s.tags.items()), s.rate, s.channels, len(s.offsets), s.samples, s.duration, s.crc_ok, s.crc_bad, s.skipped, s.table_frames, s.offsets, s.seek_points))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, INDEX)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_media(media: DataFrame) -> DataFrame:
    """Digests of payload and media, read back from the stored bytes, and the stream's features as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in DIGEST.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGEST.split(", ")]
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                rows = []
                for doc_id, cell in zip(b.column(0).to_pylist(), b.column(1)):
                    data = cell.as_py()
                    s = read_stream(data)
                    payload = s.payload
                    offsets = zlib.crc32(np.array(s.offsets, "<u8").tobytes())
                    feature = f"samples={s.samples};rate={s.rate};frames={len(s.offsets)};table={s.table_frames};crc_ok={s.crc_ok};crc_bad={s.crc_bad};skipped={s.skipped};offsets_crc32={offsets}"
                    rows.append((doc_id, int(s.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                cols = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return media.mapInArrow(run, DIGEST)


def op10_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    stored = materialise(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return digest_media(stored)
