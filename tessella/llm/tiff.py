"""TIFF columns: page directories, strips and tiles, PackBits, LZW and deflate, predictors (operator 4)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Tag numbers, field sizes by type, and compression schemes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
UNIT = 576


class BadTiff(ValueError):
    """The bytes are not a TIFF this module can read."""


def directories(data: bytes) -> list[dict[int, list[int]]]:
    """The pages' tags, in the order of the chain of directories."""
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise BadTiff("no TIFF header")
    at, seen, pages = struct.unpack_from(order + "I", data, 4)[0], set(), []
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 2 + 12 * n + 4 > len(data):
            raise BadTiff("directory runs over the end")
        tags = {"order": order}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            total = FIELD_SIZE.get(kind, 0) * count
            place = at + 2 + 12 * k + 8
            if total > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if place + total > len(data):
                raise BadTiff("a field lies outside the file")
            if kind in (1, 3, 4):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, place))
        pages.append(tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a count byte, then literal bytes or one byte to repeat."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """The inverse of unpack_bits."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; codes grow one entry early, as the format has it."""
    out, table, width, buffer, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        buffer, held = (buffer << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = buffer >> held
        buffer &= (1 << held) - 1
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code] if table else bytes((code,))
            if not table:
                table = [bytes((k,)) for k in range(256)] + [b"", b""]
        else:
            if code > len(table):
                raise BadTiff("LZW code out of order")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 - (0 if last is None else 0) and width < 12:
            width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of unpack_lzw."""
    out, buffer, held, width = bytearray(), 0, 0, 9
    table = {bytes((k,)): k for k in range(256)}
    following = 258

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer, held = (buffer << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(buffer >> held)
            buffer &= (1 << held) - 1

    put(256)
    now = b""
    for k in range(len(data)):
        grown = now + data[k : k + 1]
        if grown in table:
            now = grown
            continue
        put(table[now])
        table[grown] = following
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
        elif following >= 4094:
            put(256)
            table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
        now = data[k : k + 1]
    if now:
        put(table[now])
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if held:
        out.append((buffer << (8 - held)) & 255)
    return bytes(out)


def decode_page(data: bytes, tags: dict) -> np.ndarray:
    """The pixels of a page as (height, width, samples); bit depths of 8 and 16."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, samples, scheme, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS, [1]))
    if len(bits) != 1 or not bits <= {8, 16}:
        raise BadTiff("only 8 and 16 bits a sample are read")
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor} is not read")
    kind = np.dtype(f"{tags['order']}u{bits.pop() // 8}")
    tiled, planes = TILE_OFFSETS in tags, samples if one(PLANAR, 1) == 2 else 1
    deep = samples // planes
    tw, th = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h) or 1)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, []))
    across, down = -(-w // tw) if tw else 0, -(-h // th) if th else 0
    if len(offsets) != across * down * planes or len(counts) != len(offsets) or not w * h:
        raise BadTiff("strips or tiles don't make the page")
    page = np.empty((h, w, samples), kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, h - y)
        size = rows * tw * deep * kind.itemsize
        raw = data[at : at + n]
        if scheme == PACKBITS:
            raw = unpack_bits(raw, size)
        elif scheme == LZW:
            raw = unpack_lzw(raw)
        elif scheme in (ADOBE_DEFLATE, DEFLATE):
            try:
                raw = zlib.decompressobj().decompress(raw, size)  # no more than the page has room for
            except zlib.error as e:
                raise BadTiff(f"deflate: {e}") from e
        elif scheme != NONE:
            raise BadTiff(f"compression {scheme} is not read")
        if len(raw) < size:
            raise BadTiff("a strip or tile is too short")
        part = np.frombuffer(raw, kind, rows * tw * deep).reshape(rows, tw, deep)
        if predictor == 2:
            part = np.add.accumulate(part.astype(page.dtype), axis=1, dtype=page.dtype)
        page[y : y + rows, x : x + tw, plane * deep : (plane + 1) * deep] = part[: h - y, : w - x]
    return page


def encode(pages: list[np.ndarray], scheme: int = ADOBE_DEFLATE, predictor: int = 2, rows: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of 8-bit or 16-bit pages (height, width, samples), in strips of some rows or in tiles (width, height)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for page in pages:
        h, w, samples = page.shape
        tw, th = tile or (w, min(rows, h))
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = part.astype(page.dtype.newbyteorder(order)).tobytes()
                raw = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, ADOBE_DEFLATE: lambda r: zlib.compress(r, 1), DEFLATE: lambda r: zlib.compress(r, 1)}[scheme](raw)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) & 1)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [page.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        place = [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [th]), (STRIP_COUNTS, 4, counts)]
        fields = sorted(fields + place + [(SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])])
        entries = b""
        for tag, kind, values in fields:
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                where = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) & 1)
            else:
                where = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def page_feature(page: np.ndarray) -> str:
    """Size, samples, mean, deviation and entropy of a page, from its histogram."""
    flat = page.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    n, values = flat.size, np.arange(len(counts))
    mean = float((counts * values).sum()) / n
    spread = max(0.0, float((counts * values * values).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]};mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def tiff_pages(df: DataFrame, content: str = "media", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, pixels (row by row, native order), feature, error.

    Bytes that can't be read give one row with an error, for that page or the whole; null or empty bytes are such.
    Columns named in `keep` are carried along. Ids repeat as they come; an empty table gives no rows.
    """
    kinds = dict(df.dtypes)
    carried = [id_col, *keep]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, at, held = [], [], 0
            for i, data in enumerate(b["__m"]):
                try:
                    pages = directories(data or b"")
                    if not pages:
                        raise BadTiff("no page")
                except (BadTiff, struct.error) as e:
                    rows.append((0, None, None, None, None, None, None, str(e)))
                    at.append(i)
                    continue
                for k, tags in enumerate(pages):
                    try:
                        p = decode_page(data, tags)
                        rows.append((k, p.shape[1], p.shape[0], p.shape[2], p.dtype.itemsize * 8, p.tobytes(), page_feature(p), None))
                        held += p.nbytes
                    except (BadTiff, struct.error, KeyError, IndexError) as e:
                        rows.append((k, None, None, None, None, None, None, str(e)))
                    at.append(i)
                if held > 1 << 24:
                    yield table(b, rows, at)
                    rows, at, held = [], [], 0
            yield table(b, rows, at)

    def table(b: pd.DataFrame, rows: list, at: list[int]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["page", "width", "height", "samples", "bits", "pixels", "feature", "error"])
        for c in ("width", "height", "samples", "bits"):
            made[c] = made[c].astype("Int32")
        return pd.concat([b[carried].iloc[at].reset_index(drop=True), made], axis=1)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", page int, width int, height int, samples int, bits int, pixels binary, feature string, error string"
    return df.select(*carried, F.col(content).alias("__m")).mapInPandas(run, schema)


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to a positive multiple of `unit`,
    as the samples of a one-page TIFF of that width. A null text counts as empty: one row of 255."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                sizes, media = [], []
                for t in part["__t"]:
                    raw = (t or "").encode()
                    sizes.append(len(raw))
                    raw = raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\xff")
                    media.append(encode([np.frombuffer(raw, np.uint8).reshape(-1, unit, 1)]))
                yield pd.DataFrame({id_col: part[id_col], "n_bytes": np.array(sizes, np.int64), "media": media})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("__t")).mapInPandas(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def text_media_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of the stored form and of what is read back from it, per document."""
    pages = tiff_pages(store_texts(docs, text, id_col), "media", id_col, keep=("n_bytes", "media"))
    return pages.select(
        id_col,
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "error",
    )
