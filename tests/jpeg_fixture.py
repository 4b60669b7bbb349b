"""JPEG files made from coefficients, for tests."""

import numpy as np

from blockweave.sources import jpeg


def image(width, height, sampling, seed=1, detail=0.15):
    rng = np.random.default_rng(seed)
    comps = [jpeg.Component(i + 1, h, v, 0) for i, (h, v) in enumerate(sampling)]
    hm, vm = max(c.h for c in comps), max(c.v for c in comps)
    for c in comps:
        c.width, c.height = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
        b = np.where(rng.random((c.height, c.width, 64)) < detail, rng.integers(-100, 100, (c.height, c.width, 64)), 0)
        b[..., 0] = rng.integers(-900, 900, (c.height, c.width))
        c.blocks = b.astype(np.int16)
    return jpeg.Image(width, height, comps)


def _head(im, marker):
    frame = bytes([8]) + im.height.to_bytes(2, "big") + im.width.to_bytes(2, "big") + bytes([len(im.components)]) + b"".join(bytes([c.id, c.h << 4 | c.v, 0]) for c in im.components)
    return b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([1] * 64)) + jpeg._segment(marker, frame)


def _tables(n):
    sets = [(jpeg.DC_LUMA, jpeg.AC_LUMA), (jpeg.DC_CHROMA, jpeg.AC_CHROMA)][:n]
    return sets, b"".join(jpeg._segment(0xC4, bytes([k << 4 | i, *t[0]]) + t[1]) for i, pair in enumerate(sets) for k, t in enumerate(pair))


def baseline(im):
    return jpeg.encode(im)


class Bits:
    def __init__(self):
        self.text = []

    def put(self, code, n):
        if n:
            self.text.append(format(code, f"0{n}b"))

    def number(self, v, n):
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def done(self):
        s = "".join(self.text)
        s += "1" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00") if s else b""


def progressive(im):
    """One component: brightness in two scans by bits, details in two bands, the second in two scans by bits."""
    (c,) = im.components
    (dc, ac), tables = _tables(1)[0][0], _tables(1)[1]
    dc, ac = jpeg._codes(*dc), jpeg._codes(*ac)
    blocks = c.blocks[:, :, list(jpeg.ZIGZAG)].reshape(-1, 64).astype(int).tolist()
    out = _head(im, 0xC2) + tables

    def scan(lo, hi, high, low, body):
        return jpeg._segment(0xDA, bytes([1, c.id, 0, lo, hi, high << 4 | low])) + body.done()

    bits, before = Bits(), 0
    for b in blocks:
        d = (b[0] >> 1) - before
        before = b[0] >> 1
        n = abs(d).bit_length()
        bits.put(*dc[n])
        bits.number(d, n)
    out += scan(0, 0, 0, 1, bits)
    bits = Bits()
    for b in blocks:
        bits.put(b[0] & 1, 1)
    out += scan(0, 0, 1, 0, bits)

    def first(lo, hi, low):
        bits = Bits()
        for b in blocks:
            run, v = 0, [int(abs(x) >> low) * (1 if x > 0 else -1) for x in b]
            last = max((k for k in range(lo, hi + 1) if v[k]), default=lo - 1)
            for k in range(lo, last + 1):
                if not v[k]:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*ac[0xF0])
                    run -= 16
                n = abs(v[k]).bit_length()
                bits.put(*ac[run << 4 | n])
                bits.number(v[k], n)
                run = 0
            if last < hi:
                bits.put(*ac[0])
        return bits

    out += scan(1, 5, 0, 0, first(1, 5, 0)) + scan(6, 63, 0, 1, first(6, 63, 1))
    bits = Bits()  # the last bits of the second band: new ones and corrections of known ones
    for b in blocks:
        new = [k for k in range(6, 64) if abs(b[k]) == 1]
        end = max(new, default=5)
        run, held = 0, []
        for k in range(6, end + 1):
            if abs(b[k]) > 1:
                held.append(abs(b[k]) & 1)
            elif b[k]:
                bits.put(*ac[run << 4 | 1])
                bits.put(int(b[k] > 0), 1)
                for x in held:
                    bits.put(x, 1)
                run, held = 0, []
            else:
                if run == 15:
                    bits.put(*ac[0xF0])
                    for x in held:
                        bits.put(x, 1)
                    run, held = 0, []
                else:
                    run += 1
        if end < 63:
            bits.put(*ac[0])
            for x in held + [abs(b[k]) & 1 for k in range(end + 1, 64) if abs(b[k]) > 1]:
                bits.put(x, 1)
    out += scan(6, 63, 1, 0, bits)
    return out + b"\xff\xd9"
