"""Source repositories as a Spark data source: one row per Python file, errors as rows."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed names that a scan leaves out.
IGNORED_DIRS = frozenset([
    ".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", "build", "dist", "node_modules", "coverage", ".idea", ".vscode",
])
IGNORED_FILES = (".env", ".env.*")
SCHEMA = "relative_path STRING, absolute_path STRING, size_bytes BIGINT, mtime_ns BIGINT, sha256 STRING, content BINARY, error_type STRING, message STRING"
HASH_BLOCK = 1 << 20


def walk(root: Path, unreadable: list[tuple] | None = None) -> Iterator[str]:
    """Relative paths of the files to read, folders in sorted order, links never followed.

    A folder that cannot be read gives an error row in ``unreadable``; without such a list it raises.
    """
    todo = [root]
    while todo:
        here = todo.pop()
        try:
            with os.scandir(here) as entries:
                listed = sorted(entries, key=lambda e: e.name)
        except OSError as bad:
            if unreadable is None:
                raise
            unreadable.append((os.path.relpath(here, root), str(here), None, None, None, None, type(bad).__name__, str(bad)))
            continue
        todo += [Path(e.path) for e in reversed(listed) if e.is_dir(follow_symlinks=False) and e.name not in IGNORED_DIRS]
        for e in listed:
            if e.is_file(follow_symlinks=False) and e.name.endswith(".py") and not any(fnmatch.fnmatch(e.name, p) for p in IGNORED_FILES):
                yield os.path.relpath(e.path, root)


def file_row(root: str, relative: str) -> tuple:
    path = Path(root, relative)
    try:
        if not path.resolve().is_relative_to(Path(root).resolve()):
            raise PermissionError("the file lies outside the root")
        stat, digest, content = path.stat(), hashlib.sha256(), bytearray()
        with path.open("rb") as f:
            while block := f.read(HASH_BLOCK):
                digest.update(block)
                content += block
        return relative, str(path), stat.st_size, stat.st_mtime_ns, digest.hexdigest(), bytes(content), None, None
    except OSError as bad:
        return relative, str(path), None, None, None, None, type(bad).__name__, str(bad)


class SourceUnavailable(OSError):
    """An indexed file cannot be read or decoded any more."""


class SourceChanged(ValueError):
    """An indexed file is no longer what was indexed."""


def read_checked(root: str, relative: str, sha256: str) -> str:
    """The text of an indexed file, if it lies inside the root and still has the hash it was indexed with."""
    from siltstone.functions.code import decode_source

    top = Path(root).resolve()
    path = (top / relative).resolve()
    if not path.is_relative_to(top):
        raise ValueError("the file lies outside the root")
    try:
        raw = path.read_bytes()
        text = decode_source(raw)
    except (OSError, UnicodeError, SyntaxError) as bad:
        raise SourceUnavailable(f"{relative} cannot be read") from bad
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise SourceChanged(f"{relative} has changed; index it again")
    return text


class Files(InputPartition):
    def __init__(self, paths: list[str], errors: list[tuple] | None = None):
        self.paths, self.errors = paths, errors or []


class Reader(DataSourceReader):
    def __init__(self, root: str, group: int):
        self.root, self.group = root, group

    def partitions(self) -> list[Files]:
        unreadable: list[tuple] = []
        paths = sorted(walk(Path(self.root), unreadable))
        return [Files(paths[k : k + self.group]) for k in range(0, len(paths), self.group)] + [Files([], unreadable)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for relative in partition.paths:
            yield file_row(self.root, relative)
        yield from partition.errors


class RepositorySource(DataSource):
    """``spark.read.format("pyrepo").option("path", root).load()``; option ``group`` is the files a task reads."""

    @classmethod
    def name(cls) -> str:
        return "pyrepo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("group", "200")))


def scan(spark: SparkSession, root: str, group: int = 200) -> DataFrame:
    """All readable Python files under ``root`` and error rows for the others."""
    path = Path(root)
    if not path.is_dir():
        raise NotADirectoryError(root)
    spark.dataSource.register(RepositorySource)
    return spark.read.format("pyrepo").option("path", str(path.resolve())).option("group", str(group)).load()


def snapshot(files: DataFrame) -> DataFrame:
    """(relative_path, sha256), what a second scan is compared with before an index goes live."""
    return files.where("error_type IS NULL").select("relative_path", "sha256")


def check_pin(root: str, commit: str) -> None:
    """The working tree must be clean and at exactly this commit."""
    import subprocess

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", root, *words], check=True, capture_output=True, text=True).stdout.strip()

    if git("rev-parse", "HEAD") != commit:
        raise ValueError("the repository is at another commit")
    if git("status", "--porcelain"):
        raise ValueError("the working tree has changes")
