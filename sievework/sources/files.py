"""Files at given paths, all or nothing: a data source's writer, manifests of folders, and packages as archives.

``write_files`` writes rows (path, content) as one file each, exactly there below a folder that must be new. Tasks write
to a folder of their own attempt beside it; the commit puts the attempts that counted together and renames once, so a
killed or repeated task leaves nothing behind, and a job that fails leaves no folder. The folder is one that the driver
and executors share. Archives depend on names and contents alone.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import shutil
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

UNSAFE = re.compile(r"[\\:\x00]|^/|//|(^|/)\.{0,2}(/|$)")
#: The time of every entry of an archive, and its mode.
EPOCH, MODE = (1980, 1, 1, 0, 0, 0), 0o100644


class Attempt(WriterCommitMessage):
    def __init__(self, folder: str) -> None:
        self.folder = folder


def _gone(folder: Path) -> None:
    """Remove a folder under whatever still writes to it: first its name, so that late tasks find nothing."""
    last = folder.with_name(f"{folder.name}.gone")
    try:
        os.rename(folder, last)
    except FileNotFoundError:
        return
    shutil.rmtree(last, ignore_errors=True)


class FilesWriter(DataSourceWriter):
    """staging: a folder beside root that the driver has made; nobody makes it again once it is gone."""

    def __init__(self, root: str, staging: str) -> None:
        self.root, self.staging = Path(root), Path(staging)

    def write(self, iterator: Iterator) -> Attempt:
        folder = self.staging / uuid.uuid4().hex
        folder.mkdir()
        for row in iterator:
            if not row.path or UNSAFE.search(row.path):
                raise ValueError(f"an unsafe path: {row.path!r}")
            file = folder / row.path
            for above in list(reversed(file.relative_to(folder).parents))[1:]:
                (folder / above).mkdir(exist_ok=True)
            with open(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out:
                out.write(row.content or b"")
        return Attempt(str(folder))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        whole = self.staging / "whole"
        whole.mkdir()
        for message in messages:
            for at, _, names in os.walk(message.folder) if message else ():
                place = whole / Path(at).relative_to(message.folder)
                place.mkdir(parents=True, exist_ok=True)
                for name in names:
                    if (place / name).exists():
                        raise FileExistsError(f"two rows for {place / name}")
                    os.rename(Path(at) / name, place / name)
        if self.root.exists():
            raise FileExistsError(str(self.root))
        os.rename(whole, self.root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _gone(self.staging)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["staging"])


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, content), text or binary, below root, which must not exist."""
    folder = Path(root.removeprefix("file://"))
    if folder.exists():
        raise FileExistsError(root)
    staging = folder.with_name(f".{folder.name}.{uuid.uuid4().hex}")
    staging.mkdir(parents=True)
    files.sparkSession.dataSource.register(Files)
    try:
        files.select("path", F.col("content").cast("binary").alias("content")).write.format("whole_files").option("staging", str(staging)).mode("append").save(str(folder))
    finally:
        _gone(staging)


def with_manifest(files: DataFrame, *told: str) -> DataFrame:
    """(folder, name, content) and a manifest.json a folder: the SHA-256 of each file by name, and the columns told."""
    hashes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.sha2(F.col("content").cast("binary"), 256)))))
    listed = files.groupBy("folder", *told).agg(hashes.alias("files"))
    manifest = listed.select("folder", F.lit("manifest.json").alias("name"), F.concat(F.to_json(F.struct(*sorted([*told, "files"]))), F.lit("\n")).alias("content"))
    return files.select("folder", "name", "content").unionByName(manifest)


def at_paths(files: DataFrame) -> DataFrame:
    return files.select(F.concat_ws("/", F.col("folder").cast("string"), "name").alias("path"), "content")


# ---- archives -------------------------------------------------------------------------------------------------------

ARCHIVE = "archive binary, sha256 string, bytes long"


def _zipped(entries: Iterator[tuple[str, bytes]]) -> bytes:
    """Sorted entries at one time and mode: equal for equal names and contents."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
        for name, content in entries:
            info = zipfile.ZipInfo(name, EPOCH)
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, MODE << 16, 3
            archive.writestr(info, content)
    return out.getvalue()


def archives(files: DataFrame, key: str = "package") -> DataFrame:
    """(key, archive, sha256, bytes): a package's files (key, path, content) as one archive, whose entries stream in order."""
    schema = T.StructType([files.schema[key], *T.StructType.fromDDL(ARCHIVE)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (row for batch in batches for row in batch.to_pylist())
        for name, entries in groupby(rows, key=lambda r: r[key]):
            whole = _zipped((r["path"], r["content"] or b"") for r in entries)
            yield pa.RecordBatch.from_pylist([{key: name, "archive": whole, "sha256": hashlib.sha256(whole).hexdigest(), "bytes": len(whole)}], arrow)

    dealt = files.select(key, "path", F.col("content").cast("binary").alias("content")).repartition(key).sortWithinPartitions(key, "path")
    return dealt.mapInArrow(run, schema)


def archive_entries(rows: DataFrame, key: str = "package") -> DataFrame:
    """(key, path, sha256, fault) of archives (key, archive): what each entry holds; a fault for what no package may have."""
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("path string, sha256 string, fault string")])
    arrow = to_arrow_schema(schema)

    def told(whole: bytes | None) -> Iterator[tuple[str | None, str | None, str | None]]:
        try:
            with zipfile.ZipFile(io.BytesIO(whole or b"")) as archive:
                seen: list[str] = []
                for info in archive.infolist():
                    unsafe = UNSAFE.search(info.filename) or info.is_dir() or info.external_attr >> 16 != MODE
                    fault = "REPEATED" if info.filename in seen else "UNSAFE" if unsafe else "UNSORTED" if seen and info.filename < seen[-1] else "TIMED" if info.date_time != EPOCH else None
                    seen.append(info.filename)
                    yield info.filename, hashlib.sha256(archive.read(info)).hexdigest(), fault
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError):
            yield None, None, "UNREADABLE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{key: row[key], "path": p, "sha256": h, "fault": f} for p, h, f in told(row["archive"])], arrow)

    return rows.select(key, "archive").mapInArrow(run, schema)


def archive_faults(rows: DataFrame, manifest: DataFrame, key: str = "package") -> DataFrame:
    """(key, path, fault) of archives that are not what the manifest (key, path, sha256) says: none for a sound package."""
    found = archive_entries(rows, key)
    both = found.where("fault is null").select(key, "path", "sha256").join(manifest.select(key, "path", F.col("sha256").alias("wanted")), [key, "path"], "full_outer")
    differs = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("wanted").isNull(), "UNEXPECTED").when(F.col("sha256") != F.col("wanted"), "CHANGED")
    return found.where("fault is not null").select(key, "path", "fault").unionByName(both.select(key, "path", differs.alias("fault")).where("fault is not null"))
