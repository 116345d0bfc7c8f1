"""Files of any storage: paths by the operating system, URIs (s3a, gs, abfss, hdfs, file) by Hadoop."""

from __future__ import annotations

import contextlib
import fnmatch
import glob
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path, PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Files whose first bytes are read at a time.
THREADS = 16
_GLOB = re.compile(r"[*?\[{]")


@dataclass(frozen=True)
class InputFile:
    path: str
    size: int = 0
    mtime: float = 0.0

    @property
    def stem(self) -> str:
        return PurePosixPath(self.path).stem


def is_uri(path: str) -> bool:
    return "://" in path


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


class Files:
    """What the engine does with single files. Row data never pass through here."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark

    @cached_property
    def spark(self) -> SparkSession:
        """Only URIs need one."""
        found = self._spark or SparkSession.getActiveSession()
        if found is None:
            raise RuntimeError("a URI needs a Spark session")
        return found

    @property
    def jvm(self):
        return self.spark._jvm

    @cached_property
    def conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def hadoop(self, path: str):
        """Hadoop's (file system, path)."""
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def key(self, path: str) -> str:
        """A path as a scan's metadata have it, with one slash after file:."""
        text = self.jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
        return plain(text if is_uri(path) else f"file:{text}")

    # --- looking ---
    def exists(self, path: str) -> bool:
        if not is_uri(path):
            return os.path.exists(path)
        fs, p = self.hadoop(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        if not is_uri(path):
            return os.path.isdir(path)
        fs, p = self.hadoop(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if it isn't there."""
        if not is_uri(path):
            return sorted(os.listdir(path)) if os.path.isdir(path) else []
        fs, p = self.hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parts(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of a table's part files, those of partitions too."""
        return sorted((PurePosixPath(f.path).name, f.size) for f in self._below(path) if PurePosixPath(f.path).name.startswith("part-"))

    def _below(self, path: str) -> Iterable[InputFile]:
        if not is_uri(path):
            for folder, _, found in os.walk(path):
                for name in found:
                    at = os.path.join(folder, name)
                    yield InputFile(at, os.path.getsize(at), os.path.getmtime(at))
            return
        fs, p = self.hadoop(path)
        if fs.exists(p):
            each = fs.listFiles(p, True)
            while each.hasNext():
                yield self._status(each.next())

    @staticmethod
    def _status(s) -> InputFile:
        path = s.getPath().toString()  # a local one has one slash
        return InputFile(re.sub("^file:/(?!/)", "file:///", path), s.getLen(), s.getModificationTime() / 1000)

    def find(self, path: str, endings: Sequence[str], pattern: str | None = None, recursive: bool = False) -> list[InputFile]:
        """Sorted and each once: a file; a folder's files with the pattern or, without one, the endings;
        or a glob's, which needs a literal beginning."""
        if not is_uri(path):
            return self._find_local(path, endings, pattern, recursive)
        if _GLOB.search(path.split("://", 1)[1].split("/", 1)[0]):
            raise ValueError(f"a glob needs a literal bucket: {path}")
        fs, p = self.hadoop(path)
        if fs.exists(p):
            status = fs.getFileStatus(p)
            if not status.isDirectory():
                return [self._status(status)]
            listed = self._below(path) if recursive else (self._status(s) for s in fs.listStatus(p) if not s.isDirectory())
            fits = (lambda n: fnmatch.fnmatchcase(n, pattern)) if pattern else (lambda n: n.lower().endswith(tuple(endings)))
            found = [f for f in listed if fits(PurePosixPath(f.path).name)]
        else:
            found = [self._status(s) for s in fs.globStatus(p) or [] if not s.isDirectory()]
        own = f"/{STATE_FOLDER}/"
        return sorted({f.path: f for f in found if own not in f.path}.values(), key=lambda f: f.path)

    @staticmethod
    def _find_local(path: str, endings: Sequence[str], pattern: str | None, recursive: bool) -> list[InputFile]:
        if os.path.isfile(path):
            found = [path]
        elif os.path.isdir(path):
            top = os.path.join(glob.escape(path), "**/" if recursive else "")
            found = glob.glob(top + (pattern or "*"), recursive=True)
            found = found if pattern else [f for f in found if f.lower().endswith(tuple(endings))]
        else:
            found = glob.glob(path, recursive=True)
        files = sorted({os.path.realpath(f) for f in found if os.path.isfile(f)})
        return [InputFile(f, os.path.getsize(f), os.path.getmtime(f)) for f in files]

    # --- contents ---
    def prefix(self, path: str, size: int) -> bytes:
        """The first bytes of a file, at most so many."""
        if not is_uri(path):
            with open(path, "rb") as f:
                return f.read(size)
        fs, p = self.hadoop(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def each(self, work, items: Sequence) -> list:
        """work(item) of each, several at a time: a look into a remote file is mostly waiting. A
        ValueError is a result."""

        def one(item):
            try:
                return work(item)
            except ValueError as x:
                return x

        if len(items) < 2:
            return [one(i) for i in items]
        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(one, items))

    def read(self, path: str) -> str:
        """A small file."""
        if not is_uri(path):
            return Path(path).read_text(encoding="utf-8")
        fs, p = self.hadoop(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # --- changes ---
    def write(self, path: str, text: str) -> None:
        """A small file, put in place by a rename."""
        draft = f"{path}.{uuid.uuid4().hex}"
        if not is_uri(path):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            Path(draft).write_text(text, encoding="utf-8")
            os.replace(draft, path)
            return
        fs, p = self.hadoop(path)
        drafted = self.hadoop(draft)[1]
        out = fs.create(drafted, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p, False)
        if not fs.rename(drafted, p):
            raise OSError(f"could not write {path}")

    def create(self, path: str) -> bool:
        """Makes an empty file unless one is there; whether it did. Atomic where the store's own create
        without overwriting is (local, HDFS, ADLS; S3 and GCS with conditional writes)."""
        if not is_uri(path):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        fs, p = self.hadoop(path)
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError as x:
            if fs.exists(p):
                return False
            raise OSError(str(x.java_exception)) from None

    def modified(self, path: str) -> float | None:
        """Seconds since the epoch; None if it is gone."""
        try:
            if not is_uri(path):
                return os.path.getmtime(path)
            fs, p = self.hadoop(path)
            return fs.getFileStatus(p).getModificationTime() / 1000
        except (FileNotFoundError, Py4JJavaError):
            return None

    def copy(self, a: str, b: str) -> None:
        if not (is_uri(a) or is_uri(b)):
            os.makedirs(os.path.dirname(b) or ".", exist_ok=True)
            shutil.copy2(a, b)
            return
        (from_fs, p), (to_fs, q) = self.hadoop(a if is_uri(a) else f"file://{a}"), self.hadoop(b if is_uri(b) else f"file://{b}")
        to_fs.mkdirs(q.getParent())
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, p, to_fs, q, False, self.conf):
            raise OSError(f"could not copy {a} to {b}")

    def delete(self, path: str) -> None:
        """A file or a whole folder; nothing if it isn't there."""
        if is_uri(path):
            fs, p = self.hadoop(path)
            fs.delete(p, True)
        elif os.path.isdir(path):
            shutil.rmtree(path)
        else:
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)


#: The folder of ledgers below a source, which no listing returns.
STATE_FOLDER = ".tidegate"


def plain(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)
