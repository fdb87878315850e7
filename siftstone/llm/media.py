"""Media columns: what an ISO media container says about its tracks, read from its boxes.

The nested boxes are walked by their sizes and the sample tables (or the track
runs of fragments) decoded with numpy; payloads are located, not decoded. A row
of the input is one file; the result has a row per track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, to_batches, whole_text

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf", b"edts", b"dinf", b"udta"}
NOT_SYNC = 0x10000
FRAME, WIDTH, HEIGHT, KEY_EVERY, PER_CHUNK, TIMESCALE, DELTA = 192, 16, 12, 8, 16, 1000, 40


# --- walking boxes -------------------------------------------------------------------------------------------------


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """``path, box start, body start, body end`` of every box, parents before children.

    Sizes of 64 bits, boxes up to the end of the file and ``uuid`` boxes are
    understood. A box that leaves its parent is a ``ValueError``.
    """
    todo = [((), start, len(data) if end is None else end)]
    while todo:
        path, at, stop = todo.pop()
        if at == stop:
            continue
        if stop - at < 8:
            raise ValueError(f"{stop - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if stop - at < 16:
                raise ValueError(f"short box header at {at}")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = stop - at
        if kind == b"uuid":
            body += 16
        if at + size > stop or at + size < body:
            raise ValueError(f"box {kind.decode('latin-1')} at {at} has size {size}")
        own = (*path, kind)
        yield own, at, body, at + size
        todo.append((path, at + size, stop))
        if kind in CONTAINERS:
            todo.append((own, body, at + size))


def _numbers(data: memoryview, at: int, stop: int, kind: str, count: int, each: int = 1) -> np.ndarray:
    need = np.dtype(kind).itemsize * count * each
    if at + need > stop:
        raise ValueError(f"table at {at} needs {need} bytes")
    found = np.frombuffer(data, kind, count * each, at).astype("<i8")
    return found.reshape(count, each) if each > 1 else found


class Track:
    """The tables of one track, gathered while its boxes are walked."""

    def __init__(self) -> None:
        self.number, self.handler, self.codec, self.timescale, self.duration = 0, "", "", 0, 0
        self.times = np.zeros((0, 2), "<i8")
        self.sync: np.ndarray | None = None
        self.per_chunk = np.zeros((0, 3), "<i8")
        self.sizes, self.offsets = np.zeros(0, "<i8"), np.zeros(0, "<i8")
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def read(self, kind: bytes, data: memoryview, at: int, stop: int) -> None:
        word = lambda where: struct.unpack_from(">I", data, where)[0]
        if kind == b"tkhd":
            self.number = word(at + (20 if data[at] else 12))
        elif kind == b"mdhd":
            self.timescale, self.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr":
            self.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and word(at + 4):
            self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            self.times = _numbers(data, at + 8, stop, ">u4", word(at + 4), 2)
        elif kind == b"stss":
            self.sync = _numbers(data, at + 8, stop, ">u4", word(at + 4)) - 1
        elif kind == b"stsc":
            self.per_chunk = _numbers(data, at + 8, stop, ">u4", word(at + 4), 3)
        elif kind == b"stsz":
            same, count = struct.unpack_from(">II", data, at + 4)
            if same and count > len(data):
                raise ValueError(f"{count} samples in {len(data)} bytes")
            self.sizes = np.full(count, same, "<i8") if same else _numbers(data, at + 12, stop, ">u4", count)
        elif kind in (b"stco", b"co64"):
            self.offsets = _numbers(data, at + 8, stop, ">u4" if kind == b"stco" else ">u8", word(at + 4))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Offset, size and sync flag of each sample, and the duration of all in ticks."""
        n = len(self.sizes)
        offsets = np.zeros(n, "<i8")
        if n:
            if not len(self.per_chunk) or self.per_chunk[0, 0] != 1 or (np.diff(self.per_chunk[:, 0]) <= 0).any():
                raise ValueError("chunks of samples are out of order")
            chunks = np.arange(1, len(self.offsets) + 1)
            counts = self.per_chunk[np.searchsorted(self.per_chunk[:, 0], chunks, side="right") - 1, 1]
            if counts.sum() < n:
                raise ValueError(f"chunks hold {counts.sum()} of {n} samples")
            chunk = np.repeat(np.arange(len(chunks)), counts)[:n]
            before = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))[chunk]
            offsets = self.offsets[chunk] + before - before[np.minimum(first, n - 1)]
        flags = np.ones(n, bool)
        if self.sync is not None:
            if len(self.sync) and (self.sync.min() < 0 or self.sync.max() >= n):
                raise ValueError("a sync sample does not exist")
            flags[:] = False
            flags[self.sync] = True
        ticks = int((self.times[:, 0] * self.times[:, 1]).sum())
        parts = [(offsets, self.sizes, flags), *((o, s, f) for o, s, f, _ in self.runs)]
        ticks += sum(int(d.sum()) for *_, d in self.runs)
        return *(np.concatenate(x) for x in zip(*parts)), ticks


def _fragment(data: memoryview, boxes: list, moof: int, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Adds the runs of one track fragment; ``boxes`` are those of its ``traf``."""
    track, base, given, cursor = None, moof, {}, moof
    for kind, at, stop in boxes:
        flags = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
        if kind == b"tfhd":
            number, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
            track, given = tracks.get(number), dict(zip(("delta", "size", "flags"), defaults.get(number, (0, 0, 0))))
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(flags & 2)
            for bit, name in ((8, "delta"), (16, "size"), (32, "flags")):
                if flags & bit:
                    given[name], at = struct.unpack_from(">I", data, at)[0], at + 4
            cursor = base
        elif kind == b"trun" and track is not None:
            count, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
            if flags & 1:
                cursor, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first = None
            if flags & 4:
                first, at = struct.unpack_from(">I", data, at)[0], at + 4
            names = [name for bit, name in ((0x100, "delta"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
            if count > len(data):
                raise ValueError(f"{count} samples in {len(data)} bytes")
            rows = _numbers(data, at, stop, ">u4", count, len(names)).reshape(count, len(names)) if names else np.zeros((count, 0), "<i8")
            column = lambda name: rows[:, names.index(name)] if name in names else np.full(count, given[name], "<i8")
            sizes, bits = column("size"), column("flags").copy()
            if first is not None and count:
                bits[0] = first
            track.runs.append((cursor + np.concatenate(([0], np.cumsum(sizes)))[:count].astype("<i8"), sizes, (bits & NOT_SYNC) == 0, column("delta")))
            cursor += int(sizes.sum())


def tracks_of(data: bytes) -> list[dict]:
    """The tracks of a file; ``ValueError`` for what is no ISO media container."""
    view = memoryview(data)
    tracks: list[Track] = []
    defaults: dict[int, tuple] = {}
    fragments: list[tuple[int, list]] = []
    moof = -1
    try:
        for path, at, body, stop in walk(view):
            if path == (b"moov", b"trak"):
                tracks.append(Track())
            elif path == (b"moof",):
                moof = at
            elif path == (b"moof", b"traf"):
                fragments.append((moof, []))
            elif path[:2] == (b"moof", b"traf"):
                fragments[-1][1].append((path[-1], body, stop))
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, *rest = struct.unpack_from(">5I", view, body + 4)
                defaults[number] = tuple(rest)
            elif path[:2] == (b"moov", b"trak"):
                tracks[-1].read(path[-1], view, body, stop)
        if not tracks:
            raise ValueError("no track")
        for start, boxes in fragments:
            _fragment(view, boxes, start, {t.number: t for t in tracks}, defaults)
        found = []
        for track in tracks:
            offsets, sizes, sync, ticks = track.samples()
            if len(offsets) and ((offsets < 0).any() or (offsets + sizes > len(data)).any()):
                raise ValueError("a sample lies outside the file")
            # Neighbouring keyframes that touch are one range.
            keys = np.flatnonzero(sync)
            new = np.ones(len(keys), bool)
            new[1:] = (np.diff(keys) > 1) | (offsets[keys[1:]] != offsets[keys[:-1]] + sizes[keys[:-1]])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(keys)) - 1
            starts = offsets[keys[heads]]
            ends = offsets[keys[tails]] + sizes[keys[tails]] if len(keys) else starts
            found.append({
                "track": track.number, "handler": track.handler, "codec": track.codec, "timescale": track.timescale,
                "duration": (ticks or track.duration) / track.timescale if track.timescale else None,
                "n_samples": len(sizes), "n_bytes": int(sizes.sum()), "n_keyframes": len(keys),
                "keyframe_ranges": [{"sample": int(a), "samples": int(b), "start": int(c), "length": int(d)}
                                    for a, b, c, d in zip(keys[heads], tails - heads + 1, starts, ends - starts)],
                "samples": (offsets, sizes),
            })
        return found
    except (struct.error, IndexError) as error:
        raise ValueError(f"cut short: {error}") from None


RANGES = "array<struct<sample: long, samples: long, start: long, length: long>>"
COLUMNS = ("track long, handler string, codec string, timescale long, duration double, n_samples long, n_bytes long, "
           f"n_keyframes long, keyframe_ranges {RANGES}, error string")
CHECKS = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"


def payload_of(data: bytes, samples: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The bytes of all samples in order, neighbours in one slice."""
    offsets, sizes = samples
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    heads, tails = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(offsets)])) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(offsets[heads], offsets[tails] + sizes[tails]))


def media_tracks(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("doc_id",), checks: bool = False) -> DataFrame:
    """``keys`` and the media columns of each track of the files in ``content``.

    Null, empty and damaged files give one row with ``error`` set and null
    columns; a track without samples gives zeros and no ranges. Columns other
    than ``keys`` are dropped, so they cannot clash; repeated rows stay
    repeated. With ``checks`` the bytes of all samples are read back through
    the sample tables and digested.
    """
    rows = df.select(*keys, F.col(content).alias("content"))
    kinds = rows.drop("content").schema
    names = [x.split()[0] for x in COLUMNS.replace(RANGES, "ranges").split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for part in blocks(batches, "content"):
            columns: dict[str, list] = {name: [] for name in schema.names}
            for row, data in zip(part.select(keys).to_pylist(), part.column("content").to_pylist()):
                try:
                    if not data:
                        raise ValueError("no content")
                    found = tracks_of(data)
                except ValueError as error:
                    found = [{"error": str(error)}]
                for track in found:
                    more = {}
                    if checks:
                        more = {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
                        if "samples" in track:
                            payload = payload_of(data, track["samples"])
                            more |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
                    for name in schema.names:
                        columns[name].append(row[name] if name in row else track.get(name, more.get(name)))
            yield from to_batches(columns, schema)

    from pyspark.sql.types import StructType

    clash = set(keys) & set(names)
    if clash:
        raise ValueError(f"keys named like media columns: {sorted(clash)}")
    out = StructType(kinds.fields + StructType.fromDDL(COLUMNS + (f", {CHECKS}" if checks else "")).fields)
    return rows.mapInArrow(read, out)


# --- storing a text as samples -------------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def stored(payload: bytes) -> bytes:
    """A container whose one track has the payload as raw 8-bit grey frames of 192 bytes."""
    n = len(payload) // FRAME
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    wide = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    start = len(ftyp) + len(head)
    chunks = np.arange(0, n, PER_CHUNK, dtype="<i8")
    offsets = start + chunks * FRAME
    keys = np.arange(1, n + 1, KEY_EVERY)
    rest = n % PER_CHUNK
    per_chunk = [(1, min(n, PER_CHUNK), 1)] + ([(len(chunks), rest, 1)] if rest and len(chunks) > 1 else [])
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    table = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, DELTA)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(per_chunk)), b"".join(struct.pack(">III", *x) for x in per_chunk)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = _box(
        b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * DELTA, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * DELTA), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n * DELTA, 1 << 16, 1 << 8), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)
    return b"".join((ftyp, head, payload, movie))


def store_texts(df: DataFrame, text: str | Column = "text", doc_id: str | Column = "doc_id") -> DataFrame:
    """``doc_id, text_bytes, content``: each text, padded with blanks to whole frames, as a container."""
    rows = df.select((F.col(doc_id) if isinstance(doc_id, str) else doc_id).alias("doc_id"), whole_text(text).cast("binary").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts = part.column("text").to_pylist()
            content = [stored(x + b" " * ((-len(x)) % FRAME if x else FRAME)) for x in texts]
            done = pa.table({"doc_id": part.column("doc_id"), "text_bytes": pa.array(map(len, texts), pa.int64()), "content": pa.array(content, pa.binary())})
            yield from done.to_batches(max_chunksize=2048)

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    return rows.mapInArrow(store, StructType([rows.schema["doc_id"], StructField("text_bytes", LongType()), StructField("content", BinaryType())]))
