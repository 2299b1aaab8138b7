"""Media columns: ISO media containers (MP4 and relatives).

`tree` reads nested boxes by their sizes, `describe_all` decodes the sample tables and the movie fragments of every track
and gives codec, duration, sample byte ranges and keyframe byte ranges without decoding a payload, and `demux` reads a
track's stored bytes back by those ranges. `mux` writes a container with one track of uncompressed 8-bit samples.

Defined results: a null or empty text is stored as 64 zero bytes; bytes that are no container, or a damaged one (a table
larger than its box, samples beyond the file), give a null description and no payload; keyframe numbers that name no
sample are left out; a timescale of 0 counts as 1; repeated rows and equal texts give equal values; columns besides id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64  # bytes of a stored sample
PER_CHUNK = 256  # samples
KEY_EVERY = 64  # samples
RATE = 8000  # bytes, that is 8-bit samples, a second

#: Boxes that hold boxes, from the ISO base media file format (fixed values).
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


@dataclass
class Box:
    kind: bytes
    start: int  # of its header
    begin: int  # of its body
    end: int
    inner: list[Box]

    def all(self, kind: bytes) -> list[Box]:
        return [x for x in self.inner if x.kind == kind]

    def at(self, *path: bytes) -> Box:
        """The first box along a path of kinds; KeyError without one."""
        found = self
        for kind in path:
            found = next((x for x in found.inner if x.kind == kind), None)
            if found is None:
                raise KeyError(kind)
        return found


def tree(data: bytes) -> Box:
    """All boxes, below one that stands for the whole. Raises ValueError where sizes don't fit."""
    top = Box(b"", 0, 0, len(data), [])
    stack = [top]
    while stack:
        outer = stack.pop()
        at = outer.begin
        while at < outer.end:
            if outer.end - at < 8:
                raise ValueError("a box ends early")
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                if outer.end - at < 16:
                    raise ValueError("a box ends early")
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = outer.end - at
            if size < head or at + size > outer.end:
                raise ValueError("a box is larger than what holds it")
            outer.inner.append(Box(kind, at, at + head, at + size, []))
            if kind in CONTAINERS:
                stack.append(outer.inner[-1])
            at += size
    return top


@dataclass
class Description:
    codec: str
    timescale: int
    duration: int  # of the timescale
    samples: list[tuple[int, int]]  # byte ranges (offset, length)
    keyframes: list[int]  # sample numbers from 0
    track: int = 1  # its id


def _sizes(data: bytes, stsz: Box) -> list[int]:
    """Sample sizes: one for all, or a table of 32-bit numbers."""
    each, n = struct.unpack_from(">II", data, stsz.begin + 4)
    if max(each, 1) * n > len(data) or (not each and stsz.begin + 12 + 4 * n > stsz.end):
        raise ValueError("samples are larger than the file")
    return [each] * n if each else list(struct.unpack_from(f">{n}I", data, stsz.begin + 12))


def _compact_sizes(data: bytes, stz2: Box) -> list[int]:
    """Sample sizes of 4, 8 or 16 bits each."""
    bits, n = struct.unpack_from(">BI", data, stz2.begin + 7)
    if bits not in (4, 8, 16) or stz2.begin + 12 + -(-bits * n // 8) > stz2.end:
        raise ValueError("a table of sample sizes is larger than its box")
    table = data[stz2.begin + 12 : stz2.begin + 12 + -(-bits * n // 8)]
    if bits == 16:
        return list(struct.unpack(f">{n}H", table))
    return list(table) if bits == 8 else [x for byte in table for x in (byte >> 4, byte & 15)][:n]


def _track(data: bytes, trak: Box) -> Description:
    """From the sample tables of one track."""
    a = trak.at(b"tkhd").begin
    (number,) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
    a = trak.at(b"mdia", b"mdhd").begin
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    stbl = trak.at(b"mdia", b"minf", b"stbl")
    a = stbl.at(b"stsd").begin
    codec = data[a + 12 : a + 16].decode("latin-1")
    sizes = _compact_sizes(data, stbl.at(b"stz2")) if stbl.all(b"stz2") else _sizes(data, stbl.at(b"stsz"))
    n = len(sizes)
    wide = bool(stbl.all(b"co64"))
    a = stbl.at(b"co64" if wide else b"stco").begin
    (chunks,) = struct.unpack_from(">I", data, a + 4)
    if a + 8 + chunks * (8 if wide else 4) > stbl.at(b"co64" if wide else b"stco").end:
        raise ValueError("a table is larger than its box")
    offsets = struct.unpack_from(f">{chunks}{'Q' if wide else 'I'}", data, a + 8)
    a = stbl.at(b"stsc").begin
    (runs,) = struct.unpack_from(">I", data, a + 4)
    if a + 8 + 12 * runs > stbl.at(b"stsc").end:
        raise ValueError("a table is larger than its box")
    table = [struct.unpack_from(">III", data, a + 8 + 12 * i) for i in range(runs)]
    starts = [first for first, _, _ in table]
    if starts and (starts[0] != 1 or any(a >= b for a, b in zip(starts, [*starts[1:], chunks + 1], strict=True))):
        raise ValueError("runs of chunks that do not rise from the first")
    samples, k = [], 0
    for i, (first, per, _) in enumerate(table):
        last = table[i + 1][0] - 1 if i + 1 < runs else chunks
        for c in range(first - 1, last):
            at = offsets[c]
            for _ in range(min(per, n - k)):
                samples.append((at, sizes[k]))
                at += sizes[k]
                k += 1
    if k != n:
        raise ValueError("samples without a place")
    keyframes = list(range(n))  # without the box every sample is one
    if stbl.all(b"stss"):
        a = stbl.at(b"stss").begin
        (keys,) = struct.unpack_from(">I", data, a + 4)
        if a + 8 + 4 * keys > stbl.at(b"stss").end:
            raise ValueError("a table is larger than its box")
        keyframes = [x - 1 for x in struct.unpack_from(f">{keys}I", data, a + 8) if 1 <= x <= n]
    return Description(codec, timescale, duration, samples, keyframes, number)


def _fragments(data: bytes, top: Box, tracks: dict[int, Description]) -> None:
    """Add the samples of movie fragments to their tracks."""
    usual, added = {}, dict.fromkeys(tracks, 0)
    for trex in (x for mvex in top.at(b"moov").all(b"mvex") for x in mvex.all(b"trex")):
        number, _, *values = struct.unpack_from(">5I", data, trex.begin + 4)
        usual[number] = values  # duration, size and flags of a sample
    for moof in top.all(b"moof"):
        reached = moof.start  # the end of the data of the fragment's track before
        for traf in moof.all(b"traf"):
            a = traf.at(b"tfhd").begin
            has, number = struct.unpack_from(">II", data, a)
            has, a = has & 0xFFFFFF, a + 8
            base = moof.start if has & 0x20000 else reached
            if has & 0x1:
                (base,) = struct.unpack_from(">Q", data, a)
            a += (8 if has & 0x1 else 0) + (4 if has & 0x2 else 0)
            values = list(usual.get(number, (0, 0, 0)))
            for i, bit in enumerate((0x8, 0x10, 0x20)):
                if has & bit:
                    (values[i],) = struct.unpack_from(">I", data, a)
                    a += 4
            track, at = tracks[number], base
            for trun in traf.all(b"trun"):
                a = trun.begin
                has, n = struct.unpack_from(">II", data, a)
                has, a = has & 0xFFFFFF, a + 8
                if has & 0x1:
                    at, a = base + struct.unpack_from(">i", data, a)[0], a + 4
                first = None
                if has & 0x4:
                    (first,), a = struct.unpack_from(">I", data, a), a + 4
                fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if has & bit]
                if n * max(values[1] if not has & 0x200 else 1, 1) > len(data) or a + 4 * len(fields) * n > trun.end:
                    raise ValueError("samples are larger than the file")
                for k in range(n):
                    own = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, a), strict=True))
                    a += 4 * len(fields)
                    flags = first if k == 0 and first is not None else own.get(0x400, values[2])
                    if not flags & 0x10000:  # not a non-sync sample
                        track.keyframes.append(len(track.samples))
                    track.samples.append((at, own.get(0x200, values[1])))
                    added[number] += own.get(0x100, values[0])
                    at += own.get(0x200, values[1])
            reached = at
    for trak in top.at(b"moov").all(b"trak") if top.all(b"moof") else ():
        number = _track(data, trak).track
        a = trak.at(b"mdia", b"minf", b"stbl", b"stts").begin
        (runs,) = struct.unpack_from(">I", data, a + 4)
        if a + 8 + 8 * runs > trak.at(b"mdia", b"minf", b"stbl", b"stts").end:
            raise ValueError("a table is larger than its box")
        tables = sum(n * each for n, each in (struct.unpack_from(">II", data, a + 8 + 8 * i) for i in range(runs)))
        tracks[number].duration = tables + added[number]  # mdhd may count the fragments or not


def describe_all(data: bytes) -> list[Description] | None:
    """Every track, in the container's order, with the samples of its tables and of fragments; None for what is no container."""
    try:
        top = tree(data)
        found = [_track(data, trak) for trak in top.at(b"moov").all(b"trak")]
        tracks = {t.track: t for t in found}
        if not found or len(tracks) < len(found):
            return None
        _fragments(data, top, tracks)
        if any(o < 0 or o + s > len(data) for t in found for o, s in t.samples):
            return None
        if sum(s for t in found for _, s in t.samples) > len(data):  # samples that share bytes would make a payload of any size
            return None
        return found
    except (KeyError, ValueError, struct.error, IndexError):
        return None


def describe(data: bytes) -> Description | None:
    """The first track; None for what is no container."""
    found = describe_all(data)
    return found[0] if found else None


def demux(data: bytes, found: Description) -> bytes:
    """The stored samples by their byte ranges; neighbouring ranges are read together."""
    parts, begin, end = [], None, None
    for at, size in found.samples:
        if at != end:
            if begin is not None:
                parts.append(data[begin:end])
            begin = at
        end = at + size
    if begin is not None:
        parts.append(data[begin:end])
    return b"".join(parts)


def mux(payload: bytes) -> bytes:
    """A container around a payload of whole units: one track, 8-bit uncompressed samples."""
    units = len(payload) // UNIT
    chunks = -(-units // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] if units % PER_CHUNK == 0 else [(1, units, 1)] if chunks == 1 else [(1, PER_CHUNK, 1), (chunks, units % PER_CHUNK, 1)]
    keys = range(1, units + 1, KEY_EVERY)

    def head(base: int) -> bytes:
        offsets = [base + i * PER_CHUNK * UNIT for i in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), dinf, stbl),
        )
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, len(payload), 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    return head(len(head(0)) + 8) + box(b"mdat", payload)


def pad(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def feature(found: Description | None) -> str | None:
    """Codec, seconds, samples, and the keyframes' number, first and last byte range and digest of all ranges."""
    if found is None:
        return None
    ranges = [found.samples[k] for k in found.keyframes if k < len(found.samples)]
    shown = [f"{a}+{n}" for a, n in (ranges[0], ranges[-1])] if ranges else ["", ""]
    digest = zlib.crc32(",".join(f"{a}+{n}" for a, n in ranges).encode())
    return f"{found.codec.strip()};{found.duration / max(1, found.timescale):.3f}s;{len(found.samples)};{len(ranges)};{';'.join(shown)};{digest}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as UTF-8, padded, in a container."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # containers are as large as texts: few at a time
                raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1).slice(k, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def inspect(media: DataFrame, media_col: str = "media") -> DataFrame:
    """`media` without its bytes, with what the containers say and digests of the payloads that were read back.

    Where `media` has a column of a name that is added, in any case of letters, the added one counts. A file that is no
    container, whose tables don't fit or whose samples add up to more than it has, gives nulls but for its size and digest.

    Adds codec, duration_s, n_samples, keyframes (offset and length each), payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 bytes), media_bytes, media_sha256 and feature, of the first track, and tracks: the same
    of every track.
    """
    added = "codec string, duration_s double, n_samples long, keyframes array<struct<offset: long, length: long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tracks array<struct<track: long, codec: string, duration_s: double, n_samples: long, keyframes: array<struct<offset: long, length: long>>, payload_bytes: long, payload_sha256: string>>"
    names = ["codec", "duration_s", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks"]
    kept = [c for c in media.columns if c != media_col and c.lower() not in names]

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        keys_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        track_type = pa.struct([("track", pa.int64()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", keys_type), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())])
        types = [pa.string(), pa.float64(), pa.int64(), keys_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(track_type)]
        for batch in batches:
            rows = []
            for x in batch.column(batch.num_columns - 1):
                data = x.as_py() or b""
                found = describe_all(data)
                sizes = (len(data), sha256(data).hexdigest())
                if found is None:
                    rows.append((None, None, None, None, None, None, None, *sizes, None, None))
                    continue
                tracks, tail = [], b""
                for t in found:
                    payload = demux(data, t)
                    tail = tail if tracks else payload[-UNIT:]
                    keys = [{"offset": t.samples[k][0], "length": t.samples[k][1]} for k in t.keyframes if k < len(t.samples)]
                    tracks.append({"track": t.track, "codec": t.codec, "duration_s": t.duration / max(1, t.timescale), "n_samples": len(t.samples), "keyframes": keys, "payload_bytes": len(payload), "payload_sha256": sha256(payload).hexdigest()})
                rows.append((*list(tracks[0].values())[1:], zlib.crc32(tail), *sizes, feature(found[0]), tracks))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*kept, *names])

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept)
    return media.select(*kept, media_col).mapInArrow(run, f"{schema}, {added}")
