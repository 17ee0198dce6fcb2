"""Source archives: a row a member, and what the members say of a package."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are not shipped, build files, what they say of native code, native files, words for hot code.
NOT_SHIPPED = ("test", "tests", "testing", "example", "examples", "docs", "doc", "fixtures", "benchmark", "benchmarks")
BUILD_FILES = ("setup.py", "setup.cfg", "pyproject.toml", "cargo.toml", "meson.build", "build.rs")
NATIVE_MARKS = ("ext_modules", "cython", "maturin", "setuptools_rust", "setuptools-rust", "mesonpy", "meson-python")
NATIVE_ENDS = (".c", ".h", ".pyx", ".pxd", ".cpp", ".cc", ".rs")
HOT_WORDS = (
    "pars", "scann", "token", "lex", "encod", "decod", "serial", "yaml", "json", "csv", "regex", "mark", "html", "xml", "charset",
    "compress", "crypt", "hash", "multipart", "url", "date", "version", "valid",
)

_MEMBERS = "archive string, member string, size long, lines long, native_marks boolean, complete boolean"
_CHUNK = 1 << 20


def _scan(file: io.BufferedIOBase) -> tuple[int, bool]:
    """Line feeds of a file, and whether it names a native build; in chunks."""
    lines, marked, tail = 0, False, b""
    longest = max(map(len, NATIVE_MARKS))
    while chunk := file.read(_CHUNK):
        lines += chunk.count(b"\n")
        low = tail + chunk.lower()
        marked = marked or any(m.encode() in low for m in NATIVE_MARKS)
        tail = low[-longest:]
    return lines, marked


class _Unpacked(io.RawIOBase):
    """An archive's bytes, unpacked as they are read; knows whether the last ones are an archive's end."""

    OPENERS = ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open))
    BLOCK = 512

    def __init__(self, packed: pa.Buffer):
        raw, head = io.BytesIO(packed), bytes(packed[:6])
        self.file = next((opener(raw) for magic, opener in self.OPENERS if head.startswith(magic)), raw)
        self.tail = b""

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(size)
        self.tail = (self.tail + data)[-self.BLOCK :]
        return data

    def ended(self) -> bool:
        """Reads on to the end, which raises where packed bytes are cut off; an archive ends in zeros."""
        while self.read(_CHUNK):
            pass
        return self.tail == bytes(self.BLOCK)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _MEMBERS. A last row without a member says whether the archive could be read to its end."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("lines", pa.int64()), ("native_marks", pa.bool_()), ("complete", pa.bool_())])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, complete = [], True
            try:
                unpacked = _Unpacked(content.as_buffer())
                with tarfile.open(fileobj=unpacked, mode="r|") as archive:
                    for member in archive:
                        lines, marked = _scan(archive.extractfile(member)) if member.isfile() else (0, False)
                        rows.append((path, member.name, member.size, lines, marked, None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                complete = unpacked.ended()
            except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError):
                complete = False
            rows.append((path, None, None, None, None, complete))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, lines, native_marks, complete: a row a member of each tar archive, plain or compressed.

    Archives are streamed, a member at a time, so that a task holds an archive as it is
    packed and a chunk of a member. Each archive also has a row without a member, whose complete says
    whether it could be read to its end; of one that is cut off the members before are there.
    Files of no bytes are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tar,tgz,gz,bz2,xz}").load(path)
    return files.select("path", "content").mapInArrow(_members, _MEMBERS)


def _any_end(text: Column, ends: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, ends)), lambda e: F.endswith(text, e))


def _words_in(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, HOT_WORDS)), lambda w: F.contains(text, w))


def inspect_archives(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """archive, py_files, py_lines, native_files, native_build, words, summary_words of each archive of members (of read_archives()).

    Members in test, example and documentation folders don't count. summaries: archive,
    summary. An archive that is not complete has NULL numbers: its layout is not known.
    """
    name = F.lower("member")
    shipped = F.col("member").isNotNull() & ~F.arrays_overlap(F.split(name, "/"), F.array(*map(F.lit, NOT_SHIPPED)))
    build = _any_end(name, tuple(f"/{b}" for b in BUILD_FILES))
    python = F.endswith(name, F.lit(".py"))
    rows = members.select(
        "archive", "complete", (shipped & python).alias("py"), (shipped & ~python & ~build & _any_end(name, NATIVE_ENDS)).alias("native"),
        (shipped & build & F.col("native_marks")).alias("marks"), "lines", F.when(shipped, _words_in(name)).alias("words"),
    )
    # words of all members as one array of flags, so that partial sums hold a row an archive
    flags = [F.bool_or(F.array_contains("words", w)).alias(f"w{k}") for k, w in enumerate(HOT_WORDS)]
    sums = rows.groupBy("archive").agg(
        F.bool_and("complete").alias("whole"), F.count_if("py").alias("py_files"), F.coalesce(F.sum(F.when(F.col("py"), F.col("lines"))), F.lit(0)).alias("py_lines"),
        F.count_if("native").alias("native_files"), F.coalesce(F.bool_or("marks"), F.lit(False)).alias("native_build"), *flags,
    )
    words = F.array_sort(F.filter(F.array(*[F.when(F.col(f"w{k}"), F.lit(w)) for k, w in enumerate(HOT_WORDS)]), lambda w: w.isNotNull()))
    named = sums.join(summaries.withColumnRenamed("summary", "s"), "archive", "left")
    known = lambda c: F.when(F.col("whole"), c)
    return named.select(
        "archive", *[known(F.col(c)).alias(c) for c in ("py_files", "py_lines", "native_files", "native_build")],
        known(words).alias("words"), _words_in(F.lower(F.coalesce("s", F.lit("")))).alias("summary_words"),
    )
