import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from jpeg_fixture import baseline, image, progressive

from blockweave.sources import engine, jpeg, package
from blockweave.sources.package import Copy, Insert, Package, PackageError


@pytest.mark.parametrize(("width", "height", "sampling"), [(50, 30, [(1, 1)]), (64, 48, [(1, 1)] * 3), (70, 50, [(2, 2), (1, 1), (1, 1)])])
def test_jpeg_round_trip(width, height, sampling):
    im = image(width, height, sampling)
    data = baseline(im)
    got = jpeg.read(data)
    for a, b in zip(im.components, got.components, strict=True):
        assert (a.blocks == b.blocks).all()
    assert jpeg.write(data, got) == data


def test_progressive_gives_the_same_coefficients():
    im = image(40, 40, [(1, 1)], detail=0.3)
    im.components[0].blocks[..., 9:] //= 30  # small ones, to be refined
    assert (jpeg.read(progressive(im)).components[0].blocks == im.components[0].blocks).all()


def test_prefix_and_bad_files():
    data = baseline(image(24, 24, [(1, 1)]))
    prefix = jpeg.header_prefix(data)
    assert data.startswith(prefix) and data[len(prefix) : len(prefix) + 2] == b"\xff\xda"
    assert jpeg.with_prefix(data, prefix) == data and jpeg.with_prefix(data, b"") == data
    for bad in (b"", b"abc", data[:20], data[: len(prefix)]):
        with pytest.raises(jpeg.JpegError):
            jpeg.header_prefix(bad)
    with pytest.raises(jpeg.JpegError):
        jpeg.with_prefix(data, b"xx")


blocks = st.integers(0, 2**31).map(lambda s: np.random.default_rng(s).integers(-2000, 2000, (3, 64)).astype(np.int16))
place = st.integers(0, 70_000)
instruction = st.one_of(st.builds(Copy, place, place, place, place, st.integers(1, 70_000)), st.builds(Insert, place, place, blocks))


@settings(max_examples=40, deadline=None)
@given(st.lists(instruction, max_size=12), st.sampled_from(["auto", "raw", "zstd"]), st.binary(max_size=40))
def test_package_round_trip(ins, codec, prefix):
    p = Package("base-é", "DCHash", 7, 9, 3, ins, prefix)
    got = package.decoded(package.encoded(p, codec))
    want = package.merged(ins)
    assert (got.base_id, got.route, got.width, got.height, got.components, got.prefix) == ("base-é", "DCHash", 7, 9, 3, prefix)
    assert len(got.instructions) == len(want)
    for a, b in zip(got.instructions, want, strict=True):
        assert type(a) is type(b)
        assert (a == b) if isinstance(a, Copy) else (a.t_row, a.t_col) == (b.t_row, b.t_col) and (a.block == b.block).all()


def test_damaged_packages_are_errors():
    data = package.encoded(Package("b", "FPM", 2, 1, 1, [Copy(0, 0, 0, 0, 1), Insert(0, 1, np.ones((1, 64), np.int16))]), "raw")
    for bad in (b"", data[:51], b"X" + data[1:], data[:-1], data + b"\0", data[:8] + b"\x04" + data[9:]):
        with pytest.raises(PackageError):
            package.decoded(bad)
    for n in (0, 127, 128, 2**32 - 1):
        assert package.read_varint(package.varint(n), 0) == (n, len(package.varint(n)))
    with pytest.raises(PackageError):
        package.read_varint(b"\xff" * 6, 0)


# ---- grids of the reference fixtures: coefficient k of cell (row, col) is (seed + 211 row + 37 col + 13 k) % 4096 - 2048

def pattern(width, height, seed):
    r, c, k = np.ogrid[:height, :width, :64]
    return ((seed + r * 211 + c * 37 + k * 13) % 4096 - 2048).astype(np.int16)[:, :, None, :]


def sparse():
    base = pattern(8, 4, 1000)
    target = base.copy()
    for r, c, d in ((0, 2, 3), (1, 5, 4), (3, 1, 5)):
        target[r, c, 0, 0] += d
        target[r, c, 0, 1] -= d
    return target, base


def shifted():
    base = pattern(12, 4, 3000)
    target = np.roll(base, 2, axis=1)
    r, c, k = np.ogrid[:4, :2, :64]
    target[:, :2, 0] = 15000 + r * 31 + c * 7 + k
    return target, base


def total(ins, route, width, height):
    return len(package.encoded(Package("base-shift2" if route == "DCHash" else "base-fpm", route, width, height, 1, ins), "raw"))


def test_sparse_grid():
    target, base = sparse()
    assert engine.fpm(target, base, False) == [Copy(r, 0, r, 0, 8) for r in range(4)]
    assert total(engine.fpm(target, base, False), "FPM", 8, 4) == 108
    strict = engine.fpm(target, base, True)
    shown = [(x.t_row, x.t_col, x.length) if isinstance(x, Copy) else (x.t_row, x.t_col) for x in strict]
    assert shown == [(0, 0, 2), (0, 2), (0, 3, 5), (1, 0, 5), (1, 5), (1, 6, 2), (2, 0, 8), (3, 0, 1), (3, 1), (3, 2, 6)]
    assert total(strict, "FPM", 8, 4) == 546
    assert engine.equal_cells(target, base, True).mean() == 29 / 32
    assert (engine.replayed(strict, base) == target).all()


def test_shifted_grid():
    target, base = shifted()
    for strict in (True, False):
        ins = engine.dchash(target, base, strict)
        shown = [(x.t_row, x.t_col, x.b_row, x.b_col, x.length) if isinstance(x, Copy) else (x.t_row, x.t_col) for x in ins]
        assert shown == [y for r in range(4) for y in ((r, 0), (r, 1), (r, 2, r, 0, 10))]
        assert (engine.replayed(ins, base) == target).all()
    assert total(ins, "DCHash", 12, 4) == 1183
    assert all(isinstance(x, Insert) for x in engine.fpm(target, base, True))


def test_signatures_of_the_grids():
    (t, b), (_, s) = sparse(), shifted()
    base, target, other = (engine.signature(x[:, :, 0]) for x in (b, t, s))
    assert [(x[1], x[3], x[4]) for x in base[:3]] == [(1547300959844562293, 1, 4), (1280993069479172236, 1, 0), (1494949587527858317, 2, 0)]
    assert [(x[1], x[3], x[4]) for x in target[:3]] == [(4093271317449441349, 1, 5), (1280993069479172236, 1, 0), (3849619108288909681, 1, 2)]
    assert [(x[1], x[3], x[4]) for x in other[-2:]] == [(599984337808882439, 1, 5), (4936114561605840, 2, 2)]
    assert len({x[1] for x in base} & {x[1] for x in target}) == 5
    with pytest.raises(ValueError):
        engine.signature(b[:, :, 0], size=1)
    with pytest.raises(ValueError):
        engine.signature(np.zeros((4, 4, 64), np.int16))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.booleans(), st.booleans())
def test_any_grid_is_restored(seed, strict, route):
    rng = np.random.default_rng(seed)
    h, w, comps = rng.integers(1, 6), rng.integers(1, 8), rng.integers(1, 4)
    some = rng.integers(-300, 300, (4, comps, 64)).astype(np.int16)
    base, target = some[rng.integers(0, 4, (h, w))], some[rng.integers(0, 4, (h, w))]
    target[rng.random((h, w)) < 0.2, 0, 0] += 3
    ins = (engine.fpm if route else engine.dchash)(target, base, strict)
    got = engine.replayed(ins, base)
    assert (got == target).all() if strict else (np.abs(got.astype(int) - target).sum(axis=-1) <= 64).all()


def test_files_compress_and_restore():
    im = image(64, 64, [(1, 1)] * 3, seed=5)
    base = baseline(im)
    for c in im.components:
        c.blocks = c.blocks.copy()
    im.components[0].blocks[2, 3, 0] += 40
    target = baseline(im)
    for mode in engine.RoutingMode:
        result, data = engine.compress(target, base, "b", engine.CompressOptions(routing_mode=mode))
        assert result.success and result.compression_ratio > 1.5 and result.blocks_total == 64
        assert engine.restore(data, base) == target
    other = baseline(image(32, 64, [(1, 1)] * 3))
    assert not engine.compress(target, other, "b")[0].success
    halved = baseline(image(64, 64, [(2, 2), (1, 1), (1, 1)]))
    assert not engine.compress(halved, halved, "b")[0].success
    assert not engine.compress(b"junk", base, "b")[0].success
