"""Object stores: what the commit protocol needs of a file system. Data and log rows are read by Spark itself."""

from __future__ import annotations

import contextlib
import io
import os
import shutil
import tempfile
import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass

from ..errors import CopyObject, DeleteObject, ObjectAlreadyExists, ObjectDoesNotExist, ObjectIsDir


class Reader(io.RawIOBase):
    """A stored object as a file that can be sought in: each read asks the store for that range only."""

    def __init__(self, store: ObjectStore, path: str):
        self.store, self.path, self.size, self.at = store, path, store.head(path).size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if at < 0:
            raise ValueError(f"place {at}")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        part = self.store.read_at(self.path, self.at, len(buffer)) if self.at < self.size else b""
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


@dataclass(frozen=True)
class Meta:
    path: str
    modified_ms: int
    size: int


class ObjectStore(ABC):
    """Paths are relative to `base`."""

    base: str
    #: Whether list() and folder() give paths in order.
    ordered = True

    @abstractmethod
    def put(self, path: str, data: bytes) -> None: ...
    @abstractmethod
    def get(self, path: str) -> bytes: ...
    @abstractmethod
    def head(self, path: str) -> Meta: ...
    @abstractmethod
    def delete(self, path: str) -> None: ...
    @abstractmethod
    def delete_folder(self, path: str) -> None: ...
    @abstractmethod
    def list(self, prefix: str = "") -> list[Meta]: ...
    @abstractmethod
    def rename(self, old: str, new: str) -> None: ...
    @abstractmethod
    def rename_if_absent(self, old: str, new: str) -> None: ...

    def exists(self, path: str) -> bool:
        try:
            self.head(path)
        except ObjectDoesNotExist:
            return False
        return True

    def read_at(self, path: str, offset: int, size: int) -> bytes:
        return self.get(path)[offset : offset + size]

    def open(self, path: str) -> io.BufferedReader:
        return io.BufferedReader(Reader(self, path))

    @contextlib.contextmanager
    def writer(self, path: str):
        """A file to write to; the object is there, whole, once the block ends well."""
        with tempfile.TemporaryFile() as f:
            yield f
            f.seek(0)
            self.put(path, f.read())

    def uri(self, path: str = "") -> str:
        return f"{self.base}/{path}" if path else self.base

    def iterate(self, prefix: str = ""):
        yield from self.list(prefix)

    def folder(self, path: str, since: str = "") -> list[Meta]:
        """Files directly in a folder whose names are not before `since`, by path."""
        return [m for m in self.list(path + "/") if m.path.count("/") == path.count("/") + 1 and os.path.basename(m.path) >= since]


class FileStore(ObjectStore):
    """A local or mounted folder. rename_if_absent is one atomic link."""

    def __init__(self, base: str):
        self.base = base.removeprefix("file://").rstrip("/")

    def _full(self, path: str) -> str:
        return os.path.join(self.base, path)

    def put(self, path: str, data: bytes) -> None:
        full = self._full(path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        temp = f"{full}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, full)

    def get(self, path: str) -> bytes:
        try:
            with open(self._full(path), "rb") as f:
                return f.read()
        except FileNotFoundError:
            raise ObjectDoesNotExist(path) from None

    def read_at(self, path: str, offset: int, size: int) -> bytes:
        try:
            with open(self._full(path), "rb") as f:
                f.seek(offset)
                return f.read(size)
        except FileNotFoundError:
            raise ObjectDoesNotExist(path) from None

    def head(self, path: str) -> Meta:
        full = self._full(path)
        if os.path.isdir(full):
            raise ObjectIsDir(path)
        try:
            s = os.stat(full)
        except FileNotFoundError:
            raise ObjectDoesNotExist(path) from None
        return Meta(path, s.st_mtime_ns // 1_000_000, s.st_size)

    def delete(self, path: str) -> None:
        try:
            os.unlink(self._full(path))
        except FileNotFoundError:
            raise ObjectDoesNotExist(path) from None
        except OSError as e:
            raise DeleteObject(path) from e

    def delete_folder(self, path: str) -> None:
        if not os.path.isdir(self._full(path)):
            raise ObjectDoesNotExist(path)
        shutil.rmtree(self._full(path))

    def list(self, prefix: str = "") -> list[Meta]:
        """Files whose path starts with prefix, by path."""
        folder = os.path.dirname(prefix)
        found = []
        for d, _, names in os.walk(self._full(folder)):
            for n in names:
                path = os.path.relpath(os.path.join(d, n), self.base)
                if path.startswith(prefix) and not path.endswith(".crc"):
                    try:
                        found.append(self.head(path))
                    except ObjectDoesNotExist:  # it went meanwhile
                        continue
        return sorted(found, key=lambda m: m.path)

    def folder(self, path: str, since: str = "") -> list[Meta]:
        """One listing of names; only those not before `since` are looked at."""
        try:
            with os.scandir(self._full(path)) as entries:
                found = [e.name for e in entries if e.name >= since and not e.name.endswith(".crc") and e.is_file()]
        except FileNotFoundError:
            return []
        out = []
        for n in sorted(found):
            try:
                out.append(self.head(f"{path}/{n}"))
            except ObjectDoesNotExist:  # it went meanwhile
                continue
        return out

    def rename(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(self._full(new)), exist_ok=True)
        try:
            os.replace(self._full(old), self._full(new))
        except FileNotFoundError:
            raise ObjectDoesNotExist(old) from None
        except OSError as e:
            raise CopyObject(f"{old} to {new}") from e

    def rename_if_absent(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(self._full(new)), exist_ok=True)
        try:
            os.link(self._full(old), self._full(new))
        except FileExistsError:
            raise ObjectAlreadyExists(new) from None
        except FileNotFoundError:
            raise ObjectDoesNotExist(old) from None
        except OSError as e:
            raise CopyObject(f"{old} to {new}") from e
        try:
            self.delete(old)
        except DeleteObject:
            pass  # committed all the same


class HadoopStore(ObjectStore):
    """A folder of any file system that Spark reads (hdfs, s3a, abfs, gs, viewfs), by Spark's own client.

    rename_if_absent is the file system's rename without overwriting: atomic on HDFS. Object stores have none; there
    the table needs a lock or a log store besides.
    """

    def __init__(self, spark, base: str):
        self.base = base.rstrip("/")
        sc = spark.sparkContext
        self._jvm, self._gateway = sc._jvm, sc._gateway
        self._conf = sc._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._root = self._fs.makeQualified(self._path("")).toString().rstrip("/")

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}" if path else self.base)

    def put(self, path: str, data: bytes) -> None:
        """Written under another name, then moved: no reader sees a part of it."""
        temp = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp".lstrip("/")
        out = self._fs.create(self._path(temp), True)
        out.write(bytearray(data), 0, len(data))
        out.close()
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(path), False)
        self.rename(temp, path)

    def read_at(self, path: str, offset: int, size: int) -> bytes:
        self.head(path)
        stream = self._fs.open(self._path(path))
        try:
            stream.seek(offset)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()

    def get(self, path: str) -> bytes:
        return self.read_at(path, 0, self.head(path).size)

    def _meta(self, status) -> Meta:
        return Meta(status.getPath().toString()[len(self._root) + 1 :], status.getModificationTime(), status.getLen())

    def head(self, path: str) -> Meta:
        if not self._fs.exists(self._path(path)):
            raise ObjectDoesNotExist(path)
        status = self._fs.getFileStatus(self._path(path))
        if status.isDirectory():
            raise ObjectIsDir(path)
        return Meta(path, status.getModificationTime(), status.getLen())

    def delete(self, path: str) -> None:
        if not self._fs.exists(self._path(path)):
            raise ObjectDoesNotExist(path)
        if not self._fs.delete(self._path(path), False):
            raise DeleteObject(path)

    def delete_folder(self, path: str) -> None:
        if not self._fs.exists(self._path(path)):
            raise ObjectDoesNotExist(path)
        self._fs.delete(self._path(path), True)

    def iterate(self, prefix: str = ""):
        """Page by page as the file system lists them, in its order."""
        folder = self._path(os.path.dirname(prefix))
        if not self._fs.exists(folder):
            return
        found = self._fs.listFiles(folder, True)
        while found.hasNext():
            m = self._meta(found.next())
            if m.path.startswith(prefix) and not m.path.endswith(".crc"):
                yield m

    def list(self, prefix: str = "") -> list[Meta]:
        return sorted(self.iterate(prefix), key=lambda m: m.path)

    def folder(self, path: str, since: str = "") -> list[Meta]:
        if not self._fs.exists(self._path(path)):
            return []
        found = self._fs.listLocatedStatus(self._path(path))
        out = []
        while found.hasNext():
            status = found.next()
            if status.isFile() and status.getPath().getName() >= since and not status.getPath().getName().endswith(".crc"):
                out.append(Meta(f"{path}/{status.getPath().getName()}", status.getModificationTime(), status.getLen()))
        return sorted(out, key=lambda m: m.path)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.exists(self._path(old)):
            raise ObjectDoesNotExist(old)
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise CopyObject(f"{old} to {new}")

    def rename_if_absent(self, old: str, new: str) -> None:
        from py4j.protocol import Py4JJavaError

        if not self._fs.exists(self._path(old)):
            raise ObjectDoesNotExist(old)
        self._fs.mkdirs(self._path(new).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        none = self._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(old), self._path(new), none)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(new)):
                raise ObjectAlreadyExists(new) from None
            raise CopyObject(f"{old} to {new}") from e


def store_of(spark, path: str) -> ObjectStore:
    """FileStore for plain paths and file:, else the file system that Spark knows by the path's scheme."""
    return HadoopStore(spark, path) if "://" in path and not path.startswith("file:") else FileStore(path)


class FaultyStore(FileStore):
    """A FileStore with switches for tests: copies or deletes fail while they are set."""

    fail_copy = fail_delete = False

    def rename_if_absent(self, old: str, new: str) -> None:
        if self.fail_copy:
            raise CopyObject(new)
        super().rename_if_absent(old, new)

    def delete(self, path: str) -> None:
        if self.fail_delete:
            raise DeleteObject(path)
        super().delete(path)
