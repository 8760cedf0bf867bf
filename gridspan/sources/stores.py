"""Stores: keys to bytes, whole or by range, with listing and, where they can, writing."""

from __future__ import annotations

import mmap
import os
import urllib.error
import urllib.request
import zipfile
from collections import OrderedDict

from pyarrow import fs


class Store:
    """A read-only store of named byte strings; keys use slashes."""

    def get(self, key: str, offset: int = 0, length: int | None = None) -> bytes | None:
        """The bytes of a key from ``offset`` (negative: from the end), or None if there is no such key."""
        raise NotImplementedError

    def keys(self, prefix: str = "") -> list[str]:
        raise NotImplementedError

    def put(self, key: str, data: bytes) -> None:
        raise PermissionError("this store can't be written")

    def delete(self, key: str) -> None:
        raise PermissionError("this store can't be written")

    def move(self, key: str, to: str) -> None:
        """Another name for a key's bytes, in place of what has that name."""
        self.put(to, self.get(key))
        self.delete(key)

    def size(self, key: str) -> int | None:
        data = self.get(key)
        return None if data is None else len(data)


class Pages:
    """A key's bytes as a sequence: aligned pages are fetched by range as they are asked for, missing neighbours in one
    request, and the last used ones are kept."""

    def __init__(self, store: Store, key: str, page: int = 64 << 10, most: int = 512):
        self.store, self.key, self.page, self.most = store, key, page, most
        self.size, self.held = store.size(key), OrderedDict()
        if self.size is None:
            raise FileNotFoundError(key)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self[at : at + 1][0]
        start, stop, _ = at.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // self.page, (stop - 1) // self.page
        pages = {}
        n = first
        while n <= last:
            if n in self.held:
                pages[n] = self.held[n]
                self.held.move_to_end(n)
                n += 1
                continue
            end = n + 1
            while end <= last and end not in self.held:
                end += 1
            data = self.store.get(self.key, n * self.page, min(end * self.page, self.size) - n * self.page)
            for k in range(n, end):
                pages[k] = self.held[k] = data[(k - n) * self.page : (k - n + 1) * self.page]
            n = end
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        data = b"".join(pages[k] for k in range(first, last + 1))
        return data[start - first * self.page : stop - first * self.page]


def remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def open_bytes(path: str):
    """A file's bytes as a sequence: mapped if it is local, by pages if it is behind a URI."""
    if remote(path):
        folder, _, name = path.rpartition("/")
        return Pages(open_store(folder), name)
    with open(path.removeprefix("file://"), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _cut(data: bytes, offset: int, length: int | None) -> bytes:
    start = max(0, len(data) + offset) if offset < 0 else offset
    return data[start:] if length is None else data[start : start + length]


class MemoryStore(Store):
    def __init__(self, content: dict[str, bytes] | None = None):
        self.content = dict(content or {})

    def get(self, key, offset=0, length=None):
        return None if key not in self.content else _cut(self.content[key], offset, length)

    def keys(self, prefix=""):
        return sorted(k for k in self.content if k.startswith(prefix))

    def put(self, key, data):
        self.content[key] = data

    def delete(self, key):
        for k in [k for k in self.content if k == key or k.startswith(f"{key}/")]:
            del self.content[k]


class FileStore(Store):
    """A directory of any file system that Arrow can open: a local path, ``s3://``, ``hdfs://`` or another URI."""

    def __init__(self, root: str):
        self.root = root
        self._open()

    def _open(self):
        if "://" in self.root:
            self.files, self.base = fs.FileSystem.from_uri(self.root)
        else:
            self.files, self.base = fs.LocalFileSystem(), os.path.abspath(self.root)

    def __getstate__(self):
        return {"root": self.root}

    def __setstate__(self, state):
        self.__init__(state["root"])

    def _path(self, key: str) -> str:
        if any(p in ("..", ".") for p in key.split("/")):
            raise ValueError(f"no key: {key!r}")
        return f"{self.base}/{key}" if key else self.base

    def get(self, key, offset=0, length=None):
        try:
            with self.files.open_input_file(self._path(key)) as f:
                size = f.size()
                start = max(0, size + offset) if offset < 0 else min(offset, size)
                f.seek(start)
                return f.read(size - start if length is None else length)
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None
        except OSError:
            if self.size(key) is None:
                return None
            raise

    def size(self, key):
        info = self.files.get_file_info(self._path(key))
        return info.size if info.type == fs.FileType.File else None

    def keys(self, prefix=""):
        at = prefix.rpartition("/")[0]
        found = self.files.get_file_info(fs.FileSelector(self._path(at), recursive=True, allow_not_found=True))
        names = (os.path.relpath(f.path, self.base).replace(os.sep, "/") for f in found if f.type == fs.FileType.File)
        return sorted(n for n in names if n.startswith(prefix))

    def put(self, key, data):
        """Written aside and moved into place, so that a reader or a second attempt never sees a part."""
        path = self._path(key)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{os.getpid()}.tmp"
        with self.files.open_output_stream(aside) as f:
            f.write(data)
        self.files.move(aside, path)

    def move(self, key, to):
        path = self._path(to)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.files.move(self._path(key), path)

    def delete(self, key):
        info = self.files.get_file_info(self._path(key))
        if info.type == fs.FileType.File:
            self.files.delete_file(info.path)
        elif info.type == fs.FileType.Directory:
            self.files.delete_dir(info.path)


class ZipStore(Store):
    """A ZIP archive; keys below an optional prefix inside it."""

    def __init__(self, path: str):
        self.path = path
        self.archive = zipfile.ZipFile(path)
        self.names = set(self.archive.namelist())

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(state["path"])

    def get(self, key, offset=0, length=None):
        if key not in self.names:
            return None
        if offset < 0:
            offset = max(0, self.archive.getinfo(key).file_size + offset)
        with self.archive.open(key) as f:
            f.seek(offset)
            return f.read() if length is None else f.read(length)

    def keys(self, prefix=""):
        return sorted(n for n in self.names if n.startswith(prefix) and not n.endswith("/"))

    def size(self, key):
        return self.archive.getinfo(key).file_size if key in self.names else None


class HttpStore(Store):
    """Keys below a URL, by range requests. Listing needs a consolidated catalog."""

    def __init__(self, url: str, headers: dict[str, str] | None = None):
        self.url, self.headers = url.rstrip("/"), dict(headers or {})

    def get(self, key, offset=0, length=None):
        request = urllib.request.Request(f"{self.url}/{urllib.request.quote(key)}", headers=self.headers)
        if offset < 0:
            request.add_header("Range", f"bytes={offset}")
        elif offset or length is not None:
            request.add_header("Range", f"bytes={offset}-{'' if length is None else offset + length - 1}")
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                data = answer.read()
                return data if answer.status == 206 or not request.has_header("Range") else _cut(data, offset, length)
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            if e.code == 416:
                return b""
            raise

    def size(self, key):
        request = urllib.request.Request(f"{self.url}/{urllib.request.quote(key)}", headers=self.headers | {"Range": "bytes=0-0"})
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                if answer.status == 206:
                    return int(answer.headers["Content-Range"].rpartition("/")[2])
                return int(answer.headers["Content-Length"]) if "Content-Length" in answer.headers else len(answer.read())
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            if e.code == 416:
                return 0
            raise

    def keys(self, prefix=""):
        raise NotImplementedError("an HTTP store can't list its keys")


def open_store(path: str) -> Store:
    if path.startswith(("http://", "https://")):
        return HttpStore(path)
    if path.endswith(".zip"):
        return ZipStore(path)
    return FileStore(path)


def pack_zip(store: Store, path: str) -> None:
    """All keys as an archive of stored entries, moved into place when whole."""
    with zipfile.ZipFile(f"{path}.tmp", "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        for key in store.keys():
            archive.writestr(zipfile.ZipInfo(key), store.get(key))
    os.replace(f"{path}.tmp", path)


def sniff(path: str) -> str:
    """The format of a source: ``hdf5``, ``zarr`` or ``zip``."""
    if path.startswith(("http://", "https://")):
        start = HttpStore(path.rpartition("/")[0]).get(path.rpartition("/")[2], 0, 8)
    elif os.path.isdir(path):
        names = set(os.listdir(path))
        if names & {"zarr.json", ".zarray", ".zgroup", ".zmetadata"}:
            return "zarr"
        raise ValueError(f"{path} holds no array metadata")
    else:
        with open(path, "rb") as f:
            start, at = f.read(8), 512
            while start != b"\x89HDF\r\n\x1a\n" and f.seek(0, 2) >= at + 8:
                f.seek(at)
                if f.read(8) == b"\x89HDF\r\n\x1a\n":
                    return "hdf5"
                at *= 2
    if start == b"\x89HDF\r\n\x1a\n":
        return "hdf5"
    if start and start[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    raise ValueError(f"{path} is in no known format")
