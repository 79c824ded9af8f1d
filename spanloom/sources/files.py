"""Files below a folder of any file system that the session reaches, without running over their contents."""

from __future__ import annotations

import io
import json
import posixpath
import re
import shutil
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Characters of a record file that are read at once.
CHUNK = 1 << 20
#: Elements of a result batch.
BATCH_ROWS = 1000


def hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path) of a path, by the session's Hadoop configuration."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, parts: Iterator[str]) -> str:
    """Write one file from parts, overwriting; no more than a part is held."""
    system, place = hadoop(spark, path)
    out = system.create(place, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    system, place = hadoop(spark, path)
    return system.exists(place)


def names_in(spark: SparkSession, folder: str, folders: bool) -> list[str]:
    """Names directly in a folder, of its folders or of its files, in order."""
    system, place = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory() == folders)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of every file below a folder that isn't empty; contents aren't read. Names that begin with _ or . are hidden, as Spark has it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"))


def first_file(spark: SparkSession, folder: str, *endings: str) -> str | None:
    """The first file by path below a folder whose name ends in the first of the endings that any file has."""
    files = list_files(spark, folder)
    for ending in endings:
        found = files.where(F.endswith("path", F.lit(ending))).agg(F.min("path")).first()[0]
        if found is not None:
            return found
    return None


def first_folder(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first folder by path below a folder that has a name and holds a file."""
    inside = F.regexp_extract("path", rf"^(.*/{re.escape(name)})/", 1)
    return list_files(spark, folder).select(inside.alias("found")).where("found <> ''").agg(F.min("found")).first()[0]


def _system(path: str) -> tuple[object, str]:
    """(file system, path in it) for a worker; paths without a scheme are local, or on a disk that all share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def open_file(path: str) -> object:
    """A file to read from any position."""
    system, place = _system(path)
    return system.open_input_file(place)


def open_output(path: str) -> object:
    """A file to write, with the folders above it."""
    system, place = _system(path)
    system.create_dir(posixpath.dirname(place), recursive=True)
    return system.open_output_stream(place)


def elements(stream: object, chunk: int = CHUNK) -> Iterator[str]:
    """The texts of the elements of a JSON array, one after another; what is held is an element and a chunk."""
    reader = io.TextIOWrapper(stream, encoding="utf-8")
    decoder, blanks, space = json.JSONDecoder(), re.compile(r"[\s,]*"), re.compile(r"\s*")
    text, at, begun, more = "", 0, False, chunk
    while True:
        at = blanks.match(text, at).end()
        if not begun and at < len(text):
            if text[at] != "[":
                raise ValueError("not a JSON array")
            begun, at = True, at + 1
            continue
        if begun and text[at : at + 1] == "]":
            return
        try:
            if at >= len(text):
                raise ValueError("cut")
            _, end = decoder.raw_decode(text, at)
            if text[(after := space.match(text, end).end()) : after + 1] not in (",", "]"):  # a number may go on, as in 1.5 or 1e5
                raise ValueError("cut")
        except ValueError as e:
            read = reader.read(more)
            if not read:
                raise ValueError("the JSON array breaks off or an element is broken") from e
            text, at, more = text[at:] + read, 0, more * 2 if not at else chunk
            continue
        yield text[at:end]
        at = end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            ords, texts = [], []
            with open_file(path) as stream:
                for n, text in enumerate(elements(stream)):
                    ords.append(n)
                    texts.append(text)
                    if len(ords) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(ords)), pa.array(ords, pa.int64()), pa.array(texts)], ["file", "ord", "element"])
                        ords, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ords), pa.string()), pa.array(ords, pa.int64()), pa.array(texts, pa.string())], ["file", "ord", "element"])


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, element) of the JSON array files at a path or pattern: each element's text with its position.

    A file is read by one task as a stream, so that it may be larger than
    memory; many files go to many tasks.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(_split, "file string, ord bigint, element string")


def archive_members(path: str) -> Iterator[tuple[zipfile.ZipFile, zipfile.ZipInfo]]:
    """The files of a zip archive, with the open archive; only what is asked for is read."""
    with open_file(path) as stream, zipfile.ZipFile(stream) as archive:
        for member in archive.infolist():
            if not member.is_dir():
                yield archive, member


def _extract(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            names, sizes = [], []
            for archive, member in archive_members(path):
                name = posixpath.normpath(member.filename)
                if name.startswith(("/", "../")):
                    raise ValueError(f"{path}: {member.filename} leads out of the target")
                with archive.open(member) as packed, open_output(f"{target}/{name}") as out:
                    shutil.copyfileobj(packed, out, CHUNK)
                names.append(name)
                sizes.append(member.file_size)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["archive", "name", "size"])


def unpack_archives(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(archive, name, size) of every file of every zip archive below source, unpacked into target, once.

    Each archive is a task that copies its files in chunks, so neither archives
    nor files have to fit into memory; a repeated task writes the same files
    again. The list lies in target as a table whose _SUCCESS marks that all is
    unpacked, so a second call unpacks nothing. A name that leads out of the
    target is refused.
    """
    ship(spark)
    listed = f"{target}/_members"
    if not exists(spark, f"{listed}/_SUCCESS"):
        archives = list_files(spark, source).where(F.endswith("path", F.lit(".zip"))).select("path")
        apart = archives.repartition(max(1, min(archives.count(), 10_000)))
        apart.mapInArrow(lambda batches: _extract(batches, target), "archive string, name string, size bigint").write.mode("overwrite").parquet(listed)
    return spark.read.parquet(listed)
