"""JPEG files to quantised coefficients and back (ITU T.81, Huffman coding, baseline and progressive).

Only the entropy coding is undone: nothing is dequantised. Writing takes another file's frame and tables of
quantisation and gives a baseline scan with the standard's example Huffman tables, so restoring a file that
was made so gives its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from .package import ZIGZAG

# The example Huffman tables of the standard (annex K.3): codes of each length, symbols.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    bytes.fromhex(
        "0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)


class JpegError(ValueError):
    """Not a JPEG that can be read here."""


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    width: int = 0
    height: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 64), np.int16))  # natural order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict = field(default_factory=dict)  # quantisation by table number, natural order

    def luma(self) -> int:
        """Place of the luma component: the only one, else the first of id 1, else the first of the largest grid."""
        if len(self.components) == 1:
            return 0
        ones = [i for i, c in enumerate(self.components) if c.id == 1]
        return ones[0] if ones else max(range(len(self.components)), key=lambda i: self.components[i].width * self.components[i].height)


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start of its body, end of its body) up to the end; a scan's entropy-coded data is skipped over."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        m = data[at]
        at += 1
        if m == 0xD9:
            return
        if 0xD0 <= m <= 0xD8 or m == 1:
            continue
        if at + 2 > len(data):
            raise JpegError("segment is cut off")
        n = int.from_bytes(data[at : at + 2], "big")
        if n < 2 or at + n > len(data):
            raise JpegError("segment of a wrong length")
        yield m, at + 2, at + n
        at += n
        if m == 0xDA:
            while at + 1 < len(data) and (data[at] != 0xFF or data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 1


def header_prefix(data: bytes) -> bytes:
    """All bytes before the first scan's marker."""
    for m, start, _ in segments(data):
        if m == 0xDA:
            return data[: start - 4]
    raise JpegError("no scan")


def with_prefix(data: bytes, prefix: bytes) -> bytes:
    """``data`` with everything before its first scan replaced; an empty prefix changes nothing."""
    if not prefix:
        return data
    if prefix[:2] != b"\xff\xd8":
        raise JpegError("the prefix has no start of image")
    return prefix + data[len(header_prefix(data)) :]


class _Bits:
    """A scan's bits between two restart markers."""

    def __init__(self, data: bytes) -> None:
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\x00" * 16
        self.limit = (len(self.data) - 16) * 8
        self.at = 0

    def peek(self) -> int:
        byte, bit = self.at >> 3, self.at & 7
        return int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - bit) & 0xFFFF

    def bits(self, n: int) -> int:
        if not n:
            return 0
        byte, bit = self.at >> 3, self.at & 7
        self.at += n
        if self.at > self.limit + 64:
            raise JpegError("scan is cut off")
        return int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - bit - n) & (1 << n) - 1

    def symbol(self, table: np.ndarray) -> int:
        x = int(table[self.peek()])
        if not x:
            raise JpegError("unknown Huffman code")
        self.at += x >> 8
        if self.at > self.limit + 64:
            raise JpegError("scan is cut off")
        return x & 255

    def number(self, n: int) -> int:
        """A signed number of n bits."""
        x = self.bits(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _lookup(lengths, symbols) -> np.ndarray:
    """For every 16 bits: length of the code they begin with and its symbol."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def read(data: bytes) -> Image:
    """The coefficients of a JPEG file."""
    huffman: dict[tuple[int, int], np.ndarray] = {}
    tables: dict[int, np.ndarray] = {}
    image, progressive, restart = None, False, 0
    for m, a, b in segments(data):
        body = data[a:b]
        if m == 0xC4:
            at = 0
            while at < len(body):
                lengths = body[at + 1 : at + 17]
                n = sum(lengths)
                huffman[body[at] >> 4, body[at] & 15] = _lookup(lengths, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif m == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                zigzag = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1)
                tables[body[at] & 15] = np.zeros(64, np.int64)
                tables[body[at] & 15][list(ZIGZAG)] = zigzag
                at += 65 + 64 * wide
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise JpegError("not 8 bits a sample")
            progressive = m == 0xC2
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
            if not image.width or not image.height or not image.components:
                raise JpegError("empty image")
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
            for c in image.components:
                c.width, c.height = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
                c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)  # zig-zag order, with padding
        elif 0xC3 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise JpegError("a kind of JPEG that is not read here")
        elif m == 0xDA:
            if image is None:
                raise JpegError("scan before frame")
            end = b
            while end + 1 < len(data) and (data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            _scan(image, body, data[b:end], huffman, restart, progressive)
    if image is None:
        raise JpegError("no frame")
    image.tables = tables
    for c in image.components:
        natural = np.empty((c.height, c.width, 64), np.int16)
        natural[:, :, list(ZIGZAG)] = c.blocks[: c.height, : c.width]
        c.blocks = natural
    return image


def _parts(data: bytes) -> list[bytes]:
    """A scan's data, cut at restart markers."""
    out, at, begin = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        at += 2
    return [*out, data[begin:]]


def _scan(image: Image, head: bytes, data: bytes, huffman: dict, restart: int, progressive: bool) -> None:
    n = head[0]
    picked = []
    for i in range(n):
        c = next((x for x in image.components if x.id == head[1 + 2 * i]), None)
        if c is None:
            raise JpegError("scan of an unknown component")
        picked.append((c, head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15))
    lo, hi, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if n == 1:
        c = picked[0][0]
        units = [[(0, r, k)] for r in range(c.height) for k in range(c.width)]
    else:
        c0 = picked[0][0]
        rows, cols = c0.blocks.shape[0] // c0.v, c0.blocks.shape[1] // c0.h
        units = [[(i, r * c.v + y, k * c.h + x) for i, (c, _, _) in enumerate(picked) for y in range(c.v) for x in range(c.h)] for r in range(rows) for k in range(cols)]
    step = restart or len(units)
    for part, a in zip(_parts(data), range(0, len(units), max(1, step)), strict=False):
        bits, before, run = _Bits(part), [0] * n, 0
        for unit in units[a : a + step]:
            for i, r, k in unit:
                c, dc, ac = picked[i]
                block = c.blocks[r, k]
                if not progressive:
                    before[i] += bits.number(bits.symbol(huffman[0, dc]))
                    block[0] = before[i]
                    _ac(bits, block, huffman[1, ac])
                elif lo == 0 and not high:
                    before[i] += bits.number(bits.symbol(huffman[0, dc]))
                    block[0] = before[i] << low
                elif lo == 0:
                    block[0] |= bits.bits(1) << low
                elif not high:
                    run = _ac_first(bits, block, huffman[1, ac], lo, hi, low, run)
                else:
                    run = _ac_refined(bits, block, huffman[1, ac], lo, hi, low, run)


def _ac(bits: _Bits, block: np.ndarray, table: np.ndarray) -> None:
    k = 1
    while k < 64:
        s = bits.symbol(table)
        if s & 15:
            k += s >> 4
            if k > 63:
                raise JpegError("run beyond the block")
            block[k] = bits.number(s & 15)
            k += 1
        elif s == 0xF0:
            k += 16
        else:
            return


def _ac_first(bits, block, table, lo, hi, low, run) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        s = bits.symbol(table)
        r, n = s >> 4, s & 15
        if n:
            k += r
            if k > 63:
                raise JpegError("run beyond the block")
            block[k] = bits.number(n) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + bits.bits(r) - 1
    return 0


def _ac_refined(bits, block, table, lo, hi, low, run) -> int:
    one, k = 1 << low, lo

    def refine(k: int) -> None:
        if bits.bits(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    if not run:
        while k <= hi:
            s = bits.symbol(table)
            r, n = s >> 4, s & 15
            value = 0
            if n:
                value = one if bits.bits(1) else -one
            elif r < 15:
                run = (1 << r) + bits.bits(r)
                break
            while k <= hi:
                if block[k]:
                    refine(k)
                elif r:
                    r -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
    if run:
        for j in range(k, hi + 1):
            if block[j]:
                refine(j)
        return run - 1
    return 0


def _codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(image: Image, quantisation: dict[int, np.ndarray] | None = None) -> bytes:
    """A new baseline file of coefficients; ``quantisation`` by table number (all ones for those not given)."""
    given = quantisation or image.tables
    tables = {c.table: given.get(c.table, np.ones(64, np.int64)) for c in image.components}
    head = b"".join(_segment(0xDB, bytes([i]) + bytes(int(x) for x in t[list(ZIGZAG)])) for i, t in sorted(tables.items()))
    return b"\xff\xd8" + head + _frame_and_scan(image, image) + b"\xff\xd9"


def _frame_and_scan(frame: Image, image: Image) -> bytes:
    comps = frame.components
    out = [_segment(0xC0, bytes([8]) + frame.height.to_bytes(2, "big") + frame.width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in comps))]
    sets = [(DC_LUMA, AC_LUMA), (DC_CHROMA, AC_CHROMA)][: 1 + (len(comps) > 1)]
    for i, (dc, ac) in enumerate(sets):
        out += [_segment(0xC4, bytes([kind << 4 | i, *lengths]) + symbols) for kind, (lengths, symbols) in enumerate((dc, ac))]
    out.append(_segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c.id, 0x11 * min(i, 1)]) for i, c in enumerate(comps)) + bytes([0, 63, 0])))
    return b"".join(out) + _entropy(frame, image, [(_codes(*dc), _codes(*ac)) for dc, ac in sets])


def write(reference: bytes, image: Image) -> bytes:
    """A baseline file with ``image``'s coefficients and ``reference``'s frame, quantisation and application data."""
    frame = read(reference)
    if len(frame.components) != len(image.components) or any((a.width, a.height) != (b.width, b.height) for a, b in zip(frame.components, image.components, strict=True)):
        raise JpegError("component count or block geometry differs from the reference")
    out = [b"\xff\xd8"]
    for m, a, b in segments(reference):
        if m == 0xE0 or m == 0xEE or m == 0xDB:
            out.append(_segment(m, reference[a:b]))
        if m == 0xDA:
            break
    return b"".join(out) + _frame_and_scan(frame, image) + b"\xff\xd9"


def _entropy(frame: Image, image: Image, tables: list) -> bytes:
    comps = frame.components
    hm, vm = max(c.h for c in comps), max(c.v for c in comps)
    zz = [x.blocks[:, :, list(ZIGZAG)].tolist() for x in image.components]
    before = [0] * len(comps)
    acc, filled, out = 0, 0, bytearray()

    def put(code: int, n: int) -> None:
        nonlocal acc, filled
        acc, filled = acc << n | code, filled + n
        while filled >= 8:
            byte = acc >> (filled - 8) & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            filled -= 8
        acc &= (1 << filled) - 1

    def put_number(v: int, n: int) -> None:
        if n:
            put(v if v >= 0 else v + (1 << n) - 1, n)

    def put_block(i: int, block) -> None:
        dc, ac = tables[min(i, len(tables) - 1)]
        diff = block[0] - before[i]
        before[i] = block[0]
        n = abs(diff).bit_length()
        put(*dc[n])
        put_number(diff, n)
        run = 0
        last = max((k for k in range(1, 64) if block[k]), default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                put(*ac[0xF0])
                run -= 16
            n = abs(block[k]).bit_length()
            put(*ac[run << 4 | n])
            put_number(block[k], n)
            run = 0
        if last < 63:
            put(*ac[0])

    single = len(comps) == 1
    down, across = (comps[0].height, comps[0].width) if single else (-(-image.height // (8 * vm)), -(-image.width // (8 * hm)))
    for r in range(down):
        for k in range(across):
            for i, c in enumerate(comps):
                for y in range(1 if single else c.v):
                    for x in range(1 if single else c.h):
                        row, col = (r, k) if single else (r * c.v + y, k * c.h + x)
                        # padding repeats the last brightness and has no detail
                        put_block(i, zz[i][row][col] if row < c.height and col < c.width else [before[i], *[0] * 63])
    if filled:
        put((1 << (8 - filled)) - 1, 8 - filled)
    return bytes(out)


def samples(component: Component, quantisation: np.ndarray) -> np.ndarray:
    """A component's samples (0 to 255) with its padding: dequantised, inverse cosine transform."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    y = (component.blocks * quantisation).reshape(component.height, component.width, 8, 8).astype(np.float64)
    out = np.einsum("ux,rcuv,vy->rcxy", basis, y, basis) + 128
    return np.clip(np.rint(out), 0, 255).transpose(0, 2, 1, 3).reshape(component.height * 8, component.width * 8)


def pixels(data: bytes) -> np.ndarray:
    """RGB pixels (height x width x 3); one component is grey, colours of smaller sampling are repeated."""
    image = read(data)
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components[:3]:
        p = samples(c, image.tables.get(c.table, np.ones(64, np.int64)))
        p = p.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# ---- tables

def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, rank) of the .jpg and .jpeg files below ``folder``, ranked by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder).filter(F.col("path").rlike(r"(?i)\.jpe?g$"))
    return files.select("path", "length", "content").join(ranked(files.select("path"), "path"), "path")


def decode(files: DataFrame, key: str = "path") -> DataFrame:
    """Rows (image_id, width, height, comp, component_id, h_samp, v_samp, grid_width, grid_height, row, col, coeff, error) of the files' blocks.

    A file that can't be read gives one row with the error.
    """
    names = ["image_id", "width", "height", "comp", "component_id", "h_samp", "v_samp", "grid_width", "grid_height", "row", "col", "coeff", "error"]

    def run(batches):
        for batch in batches:
            for image_id, data in zip(batch["image_id"], batch["content"], strict=True):
                try:
                    image = read(bytes(data))
                except (JpegError, KeyError, IndexError) as e:
                    yield pd.DataFrame([[image_id, *[None] * 11, str(e) or "unreadable"]], columns=names)
                    continue
                for i, c in enumerate(image.components):
                    rows, cols = np.divmod(np.arange(c.width * c.height), c.width)
                    yield pd.DataFrame({"image_id": image_id, "width": image.width, "height": image.height, "comp": i, "component_id": c.id, "h_samp": c.h, "v_samp": c.v, "grid_width": c.width, "grid_height": c.height, "row": rows, "col": cols, "coeff": list(c.blocks.reshape(-1, 64)), "error": None}, columns=names)

    kinds = "image_id string, width int, height int, comp int, component_id int, h_samp int, v_samp int, grid_width int, grid_height int, row int, col int, coeff array<smallint>, error string"
    return files.select(F.col(key).cast("string").alias("image_id"), "content").mapInPandas(run, kinds)
