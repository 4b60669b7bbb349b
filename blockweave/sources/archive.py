"""Archives of deltas: a ZIP with manifest.json, each base once under bases/ and the deltas under deltas/."""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

SUFFIX = ".ddctpack"  # fixed value: the archives' suffix


def write_archive(path: str, manifest: dict, bases: Iterable[tuple[str, bytes]], deltas: Iterable[tuple[str, bytes]]) -> str | None:
    """Writes an archive, entries sorted by name; None without deltas. Bases and deltas are (name, content), streamed."""
    deltas = iter(deltas)
    first = next(deltas, None)
    if first is None:
        return None
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
        for name, content in bases:
            z.writestr(name, content)
        z.writestr(*first)
        for name, content in deltas:
            z.writestr(name, content)
    return path


def write_archive_of(path: str, manifest: DataFrame, bases: DataFrame, deltas: DataFrame) -> str | None:
    """The same from tables: manifest rows (target, ddct_file, base_file, original_sha256, strict_lossless), entries (name, content). Contents pass the driver one at a time."""
    entries = {r["target"]: {k: r[k] for k in ("ddct_file", "base_file", "original_sha256", "strict_lossless")} for r in manifest.orderBy("target").toLocalIterator()}
    stream = lambda df: ((r["name"], bytes(r["content"])) for r in df.dropDuplicates(["name"]).orderBy("name").toLocalIterator())
    return write_archive(path, entries, stream(bases), stream(deltas))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files below ``folder``, each by the task that holds it (a task that runs again writes the same); how many."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                path = posixpath.normpath(f"{root}/{name}")
                if not path.startswith(posixpath.normpath(root) + "/"):
                    raise ValueError(f"{name} leaves the folder")
                store.create_dir(posixpath.dirname(path), recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def manifest_of(z: zipfile.ZipFile) -> dict:
    """The archive's manifest, which must be there and be a table of entries."""
    if "manifest.json" not in z.namelist():
        raise ValueError("no manifest.json in the archive")
    found = json.loads(z.read("manifest.json"))
    if not isinstance(found, dict):
        raise ValueError("manifest.json is no table of entries")
    return found


def entry(info: dict) -> tuple[str, str, str, bool]:
    """(ddct_file, base_file, original_sha256, strict_lossless) of a manifest entry; an old key for the base is read too."""
    return str(info.get("ddct_file", "")), str(info.get("base_file", info.get("required_base", ""))), str(info.get("original_sha256", "")), bool(info.get("strict_lossless", True))


def read_archives(files: DataFrame) -> DataFrame:
    """(archive, name, content) of the entries of archives (path, content); manifest.json among them."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"archive": [path], "name": [name], "content": [z.read(name)]})

    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def read_manifests(files: DataFrame) -> DataFrame:
    """(archive, target, ddct_file, base_file, original_sha256, strict_lossless) of archives (path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows = [(path, t, *entry(x)) for t, x in manifest_of(z).items()]
                yield pd.DataFrame(rows, columns=["archive", "target", "ddct_file", "base_file", "original_sha256", "strict_lossless"])

    return files.select("path", "content").mapInPandas(run, "archive string, target string, ddct_file string, base_file string, original_sha256 string, strict_lossless boolean")


def output_root(folder: str, name: str = "deduped") -> str:
    """``folder``, made if need be; if empty or it can't be made, ``<name>_Output`` in the current folder."""
    if folder:
        try:
            os.makedirs(folder, exist_ok=True)
            return folder
        except OSError:
            pass
    out = os.path.join(os.getcwd(), f"{name}_Output")
    os.makedirs(out, exist_ok=True)
    return out
