"""An immutable directory as a dataset: inventory, checksums, identity, formats."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that an inventory leaves out, signatures of formats, and formats by extension.
EXCLUDED = frozenset({".git", ".hg", ".svn", "__pycache__", ".DS_Store", "Thumbs.db"})
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"%PDF": "pdf", b"\x1f\x8b": "gzip", b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "ole2", b"PAR1": "parquet",
    b"\x89HDF\r\n\x1a\n": "hdf5", b"SQLite format 3": "sqlite", b"II*\x00": "tiff", b"MM\x00*": "tiff", b"MATLAB 5": "matlab",
}
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonld": "jsonld", "xml": "xml", "yaml": "yaml", "yml": "yaml", "ttl": "turtle", "nt": "ntriples", "rdf": "rdfxml", "md": "markdown", "txt": "text", "png": "png",
    "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "pdf": "pdf", "zip": "zip", "gz": "gzip", "parquet": "parquet", "h5": "hdf5", "hdf5": "hdf5", "nwb": "nwb", "nii": "nifti", "edf": "edf", "db": "sqlite", "sqlite": "sqlite",
    "ods": "ods", "xlsx": "xlsx", "xls": "xls", "xlsb": "xlsb", "mat": "matlab", "boris": "boris", "docx": "docx", "pptx": "pptx", "doc": "doc", "ppt": "ppt",
}
CONTAINERS = {"zip": {"xlsx", "xlsb", "ods", "docx", "pptx", "zip"}, "hdf5": {"hdf5", "nwb", "matlab"}, "gzip": {"gzip", "nifti"}}

#: Bytes of a file that are held at a time.
BLOCK = 1 << 20


def walk(root: str, excluded: frozenset[str] = EXCLUDED) -> Iterator[str]:
    """Relative paths in order; links are never followed."""
    for folder, names, files in os.walk(root, followlinks=False):
        names[:] = sorted(n for n in names if n not in excluded and not os.path.islink(os.path.join(folder, n)))
        for f in sorted(files):
            full = os.path.join(folder, f)
            if f not in excluded and not os.path.islink(full):
                yield os.path.relpath(full, root).replace(os.sep, "/")


def skipped(root: str, excluded: frozenset[str] = EXCLUDED) -> list[tuple[str, str]]:
    """(path, reason) of what an inventory leaves out: excluded names, and links, which are never followed."""
    out = []
    for folder, names, found in os.walk(root, followlinks=False):
        for n in sorted([*names, *found]):
            full = os.path.join(folder, n)
            if n in excluded or os.path.islink(full):
                out.append((os.path.relpath(full, root).replace(os.sep, "/"), "excluded" if n in excluded else "link"))
        names[:] = sorted(n for n in names if n not in excluded and not os.path.islink(os.path.join(folder, n)))
    return out


def digest_of(path: str) -> str:
    """The digest of a file's bytes, read in blocks."""
    with open(path, "rb") as f:
        return "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256, format, conflict): files are read in blocks by the executors, whatever their size; a file that cannot be read
    has neither digest nor format."""
    base = os.path.abspath(root)
    paths = spark.createDataFrame([(p,) for p in walk(base)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path in batch.column(0).to_pylist():
                full = os.path.join(base, path)
                try:
                    with open(full, "rb") as f:
                        found = detect(path, f)
                    out.append((path, os.path.getsize(full), digest_of(full), *found))
                except OSError:
                    out.append((path, None, None, None, False))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=["path", "size", "sha256", "format", "conflict"])

    tasks = spark.sparkContext.defaultParallelism * 4
    return paths.repartition(tasks, "path").mapInArrow(run, "path string, size long, sha256 string, format string, conflict boolean")


def gate(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """One row without columns, or a failed task where the file is not the one of that digest: joined to a scan it makes the test a part
    of the scan's own plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and digest_of(path) != sha256:
                raise ValueError(f"content_withheld: {path} has changed since it was ingested")
            yield batch

    return spark.range(1, numPartitions=1).mapInArrow(run, "id long").select()


@F.pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("conflict", T.BooleanType())]))
def _format(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(p, c) for p, c in zip(path, content, strict=True)], columns=["format", "conflict"])


def detect(path: str, content: bytes | BinaryIO) -> tuple[str, bool]:
    """The format by signature before extension, and whether the two contradict each other; from bytes, or a file that is read as far
    as it has to be."""
    f = io.BytesIO(content) if isinstance(content, bytes | bytearray | memoryview) else content
    head = f.read(64)
    named = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "unknown")
    magic = next((kind for sig, kind in MAGIC.items() if head.startswith(sig)), None)
    if magic == "zip":
        inside = _zip_kind(f)
        return (inside, named != "unknown" and named != inside) if inside != "zip" else (named if named in CONTAINERS["zip"] else "zip", named not in {"unknown", *CONTAINERS["zip"]})
    if magic == "ole2":
        inside = _ole2_kind(f)
        return inside, named not in {"unknown", inside}
    if magic in CONTAINERS:
        fits = named in CONTAINERS[magic]
        return (named if fits else magic), not fits and named != "unknown"
    if magic:
        return magic, named not in {"unknown", magic}
    if named == "boris" or (named == "json" and holds(f, b"behaviors_conf")):
        f.seek(0)
        project = is_project(f.read())
        return ("boris" if project else "json"), named == "boris" and not project
    return named, named in {"png", "jpeg", "pdf", "xlsx", "parquet"}


def holds(f: BinaryIO, *wanted: bytes) -> bytes | None:
    """The first of some byte strings, in the order given, that a file holds; read in blocks."""
    f.seek(0)
    found, rest, longest = set(), b"", max(map(len, wanted))
    while block := f.read(BLOCK):
        found |= {w for w in wanted if w in rest + block}
        rest = (rest + block)[1 - longest :] if longest > 1 else b""
    return next((w for w in wanted if w in found), None)


def _ole2_kind(f: BinaryIO) -> str:
    """What a compound file holds, by the names of its streams, which stand in its directory as UTF-16."""
    streams = {s.encode("utf-16-le") + b"\0\0": kind for s, kind in (("Workbook", "xls"), ("Book", "xls"), ("WordDocument", "doc"), ("PowerPoint Document", "ppt"))}
    return streams.get(holds(f, *streams), "ole2")


def _zip_kind(f: BinaryIO) -> str:
    try:
        with zipfile.ZipFile(f) as z:
            names = set(z.namelist())
            if "xl/workbook.xml" in names:
                return "xlsx"
            if "xl/workbook.bin" in names:
                return "xlsb"
            if "word/document.xml" in names:
                return "docx"
            if "ppt/presentation.xml" in names:
                return "pptx"
            if "mimetype" in names and b"spreadsheet" in z.read("mimetype"):
                return "ods"
    except (zipfile.BadZipFile, OSError):
        pass
    return "zip"


def is_project(content: bytes) -> bool:
    """A behaviour project: JSON with the three keys that every project has."""
    try:
        document = json.loads(content.decode("utf-8-sig"))
    except (UnicodeDecodeError, ValueError):
        return False
    return isinstance(document, dict) and {"project_format_version", "behaviors_conf", "observations"} <= set(document)


def dataset_id(files: DataFrame) -> str:
    """The digest over the path-sorted lines of (path, sha256). One line a file reaches the driver, as in any manifest."""
    digest = hashlib.sha256()
    for r in files.select("path", "sha256").orderBy("path").toLocalIterator():
        digest.update(f"{r['path']}\n{r['sha256']}\n".encode())
    return "sha256:" + digest.hexdigest()


def fold(files: DataFrame) -> DataFrame:
    """The same identity as one expression, for lists that fit a row."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat(x["path"], F.lit("\n"), x["sha256"], F.lit("\n"))), ""), 256)).alias("dataset_id"))


def drift(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files added, removed or changed between two inventories."""
    a, b = then.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def listed(files: DataFrame, pattern: str = "*", format: str | None = None) -> DataFrame:
    rx = fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")
    out = files.where(F.col("path").rlike(rx))
    return out.where(F.col("format") == format) if format else out
