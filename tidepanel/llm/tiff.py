"""TIFF: a reader that walks image directories and a writer of strips, both on byte strings."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
_UNIT = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}
PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that grow one code early; 256 clears, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, last, width, hold, bits = list(first), [], b"", 9, 0, 0
    for byte in data:
        hold, bits = (hold << 8 | byte) & 0xFFFFFFFF, bits + 8
        while bits >= width:
            bits -= width
            code = hold >> bits & ((1 << width) - 1)
            if code == 256:
                words, last, width = list(first), b"", 9
                continue
            if code == 257:
                return b"".join(out)
            if not last:
                word = words[code]
            else:
                word = words[code] if code < len(words) else last + last[:1]
                words.append(last + word[:1])
            out.append(word)
            last = word
            grown = len(words) + 1
            width = 9 if grown < 512 else 10 if grown < 1024 else 11 if grown < 2048 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, hold, bits, width = bytearray(), 0, 0, 9
    codes = {bytes([i]): i for i in range(256)}
    free, word = 258, b""

    def put(code: int) -> None:
        nonlocal hold, bits
        hold, bits = hold << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(hold >> bits & 255)
        hold &= (1 << bits) - 1

    put(256)
    for b in data:
        more = word + bytes([b])
        if more in codes:
            word = more
            continue
        put(codes[word])
        codes[more] = free
        free += 1
        if free == 4094:
            put(256)
            codes, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        word = bytes([b])
    if word:
        put(codes[word])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257)
    if bits:
        out.append(hold << (8 - bits) & 255)
    return bytes(out)


def _unpacked(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.decompress(data)
    if how == LZW:
        return unpack_lzw(data)
    if how == PACKBITS:
        return unpack_bits(data)
    raise ValueError(f"compression {how}")


def _tags(data: bytes, at: int, end: str) -> tuple[dict[int, list], int]:
    (count,) = struct.unpack_from(end + "H", data, at)
    tags: dict[int, list] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        unit = _UNIT.get(kind, 1)
        where = at + 10 + 12 * k
        if unit * n > 4:
            (where,) = struct.unpack_from(end + "I", data, where)
        if where + unit * n > len(data):
            raise ValueError(f"tag {tag} lies outside the file")
        if kind in _CODE:
            tags[tag] = list(struct.unpack_from(f"{end}{n}{_CODE[kind]}", data, where))
    (following,) = struct.unpack_from(end + "I", data, at + 2 + 12 * count)
    return tags, following


def read_pages(data: bytes) -> Iterator[dict]:
    """One record for each image directory; what can't be read has an error instead of pixels. Directories in a circle end the walk."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        yield {"page": 0, "error": "not a TIFF"}
        return
    end = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(end + "I", data, 4)
    page, seen = 0, set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, following = _tags(data, at, end)
        except (ValueError, struct.error) as e:
            yield {"page": page, "error": str(e)}
            return
        try:
            yield _page(data, tags, end) | {"page": page, "error": None}
        except (ValueError, struct.error, zlib.error, KeyError, IndexError) as e:
            yield {"page": page, "error": f"{type(e).__name__}: {e}"}
        page, at = page + 1, following


def _page(data: bytes, tags: dict[int, list], end: str) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    width, height, samples, how, predictor = one(256), one(257), one(277, 1), one(259, NONE), one(317, 1)
    bits, planar = one(258, 1), one(284, 1)
    if bits not in (8, 16) or len(set(tags.get(258, [bits]))) > 1:
        raise ValueError(f"{bits} bits a sample")
    unit = np.dtype(f"{end}u{bits // 8}")
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if tiled := 322 in tags:
        tile_w, tile_h, offsets, counts = one(322), one(323), tags[324], tags[325]
    else:
        tile_w, tile_h, offsets, counts = width, min(one(278, height), height), tags[273], tags[279]
    across, down = -(-width // tile_w), -(-height // tile_h)
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise ValueError("wrong number of strips or tiles")
    image = np.zeros((planes, height, width, depth), unit.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * tile_h, cell % across * tile_w
        rows = tile_h if tiled else min(tile_h, height - top)
        if at + size > len(data):
            raise ValueError("a strip or tile lies outside the file")
        got = np.frombuffer(_unpacked(data[at : at + size], how), unit, rows * tile_w * depth).reshape(rows, tile_w, depth)
        got = got.astype(unit.newbyteorder("="))
        if predictor == 2:
            got = np.cumsum(got, axis=1, dtype=got.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        have = got[: height - top, : width - left]
        image[plane, top : top + have.shape[0], left : left + have.shape[1]] = have
    pixels = image.reshape(height, width, samples) if planar != 2 else np.moveaxis(image[..., 0], 0, 2)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor, "pixels": pixels.tobytes()}


def write_tiff(pages: list[tuple[np.ndarray, int, int]], rows_per_strip: int = 256, tile: int = 0) -> bytes:
    """Little-endian; each page is (height x width x samples of 8 bits, compression, predictor); strips, or tiles of a side."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    pack = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), DEFLATE_OLD: zlib.compress, PACKBITS: pack_bits}
    for image, how, predictor in pages:
        height, width, samples = image.shape
        step_h, step_w = (tile, tile) if tile else (min(rows_per_strip, height), width)
        offsets, counts = [], []
        for top in range(0, height, step_h):
            for left in range(0, width, step_w):
                part = image[top : top + step_h, left : left + step_w]
                if tile:
                    full = np.zeros((tile, tile, samples), np.uint8)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = part.tobytes()
                data = b"".join(pack[how](raw[i : i + step_w * samples]) for i in range(0, len(raw), step_w * samples)) if how == PACKBITS else pack[how](raw)
                offsets.append(len(out))
                counts.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [how]), (262, 3, [2 if samples > 2 else 1]), (277, 3, [samples]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [step_h]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def tiff_pages(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """One row for each page of each file: id_col, page, sizes, pixels (samples in page order, native bytes), error.

    A null or empty file, or one that isn't a TIFF, gives one row with an error; so does a page that can't be read, beside the
    other pages. Repeated files give repeated rows; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for k, data in enumerate(batch.column(1)):
                for page in read_pages(data.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([keys[k : k + 1].cast(keys.type), *[pa.array([page.get(n)], t) for n, t in zip(names, kinds, strict=True)]], [id_col, *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, data_col).mapInArrow(run, f"`{id_col}` {kind}, {PAGES}")


def features(pixels: bytes) -> str:
    """Count, mean and spread of samples and the share of steps up, as text."""
    x = np.frombuffer(pixels, np.uint8)
    if not len(x):
        return "0"
    total, squares = int(x.sum(dtype=np.int64)), int(np.einsum("i,i->", x.astype(np.int32), x.astype(np.int32), dtype=np.int64))
    up = int(np.count_nonzero(x[1:] > x[:-1]))
    return f"{len(x)}:{total / len(x):.4f}:{squares / len(x) - (total / len(x)) ** 2:.4f}:{up / len(x):.4f}"


#: Bytes of a row of the payload's image: 64 pixels of 3 samples.
ROW = 192


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a TIFF of one page: doc_id, n_bytes, media. 64 pixels of red, green and blue a row, deflate strips, horizontal predictor.

    UTF-8 bytes of the text (null: none), then spaces up to a positive multiple of 192. Equal texts give equal files.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for data in batch.column("data"):
                raw = data.as_py() or b""
                padded = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")
                sizes.append(len(raw))
                files.append(write_tiff([(np.frombuffer(padded, np.uint8).reshape(-1, ROW // 3, 3), DEFLATE, 2)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads the pages of each file back and gives the digests and features of its samples, all pages in order."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media"):
                file = data.as_py()
                pages = list(read_pages(file))
                if bad := [p["error"] for p in pages if p["error"]]:
                    raise ValueError(bad[0])
                payload = b"".join(p["pixels"] for p in pages)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
