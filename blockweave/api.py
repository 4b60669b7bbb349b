"""File-level calls: compress a JPEG against another, restore it, read its features."""

from __future__ import annotations

from .sources import engine, jpeg
from .sources.engine import CompressOptions, DedupResult, RoutingMode
from .sources.package import PackageError

__all__ = ["CompressOptions", "DedupResult", "RoutingMode", "compress_image", "decompress_image", "extract_features"]


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def compress_image(target_path: str, base_path: str, output_path: str, mode: RoutingMode = RoutingMode.AUTO, options: CompressOptions | None = None) -> DedupResult:
    """Writes the package of a target against a base; a failure writes nothing and says why."""
    options = options or CompressOptions(routing_mode=mode)
    try:
        result, data = engine.compress(_bytes(target_path), _bytes(base_path), base_path, options)
    except OSError as e:
        return DedupResult(reason=str(e))
    if result.success:
        with open(output_path, "wb") as f:
            f.write(data)
    return result


def decompress_image(package_path: str, base_path: str, output_path: str) -> bool:
    """Whether the package could be restored with the base and was written."""
    try:
        data = engine.restore(_bytes(package_path), _bytes(base_path))
        with open(output_path, "wb") as f:
            f.write(data)
    except (OSError, PackageError, jpeg.JpegError):
        return False
    return True


def extract_features(path: str, window_size: int = 2, num_transforms: int = 10) -> list[int]:
    """The unsigned feature hashes of a file's luma; raises on any failure. Sizes below 1 count as 1."""
    image = jpeg.read(_bytes(path))
    return [x[1] for x in engine.signature(image.components[image.luma()].blocks, max(1, window_size), max(1, num_transforms))]
