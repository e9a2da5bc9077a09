"""Archives: resumable download and extraction that trusts no member."""

from __future__ import annotations

import hashlib
import os
import stat
import urllib.request
import zipfile
from dataclasses import dataclass
from pathlib import Path, PurePosixPath


class UnsafeArchiveError(ValueError):
    """A member that would leave the target, is a link, or expands beyond the limits."""


@dataclass(frozen=True)
class Limits:
    members: int = 200_000
    member_bytes: int = 1 << 30
    total_bytes: int = 1 << 34
    ratio: float = 200.0


def member_path(name: str) -> PurePosixPath:
    """A member's relative path; absolute paths, drives and parent steps raise."""
    path = PurePosixPath(name.replace("\\", "/"))
    if not name.strip() or path.is_absolute() or ".." in path.parts or path.parts and path.parts[0].endswith(":"):
        raise UnsafeArchiveError(f"unsafe member {name!r}")
    return path


def inspect(archive: zipfile.ZipFile, limits: Limits) -> list[zipfile.ZipInfo]:
    """The files of an archive, once all its members are known to be harmless."""
    members = archive.infolist()
    if len(members) > limits.members:
        raise UnsafeArchiveError(f"{len(members)} members")
    seen: set[str] = set()
    total = 0
    for m in members:
        path = member_path(m.filename)
        if stat.S_ISLNK(m.external_attr >> 16):
            raise UnsafeArchiveError(f"{m.filename!r} is a link")
        if str(path).casefold() in seen:
            raise UnsafeArchiveError(f"{m.filename!r} is there twice")
        seen.add(str(path).casefold())
        total += m.file_size
        if m.file_size > limits.member_bytes or total > limits.total_bytes or m.file_size > limits.ratio * max(m.compress_size, 1):
            raise UnsafeArchiveError(f"{m.filename!r} expands too far")
    return [m for m in members if not m.is_dir()]


def extract(path: str, target: str, limits: Limits = Limits(), nested: bool = True) -> list[str]:
    """Extract into a folder that must not exist; returns the files' relative paths.  With ``nested`` the archives inside are extracted beside themselves."""
    base = Path(target)
    base.mkdir(parents=True)
    out: list[str] = []
    with zipfile.ZipFile(path) as archive:
        for m in inspect(archive, limits):
            to = base / member_path(m.filename)
            to.parent.mkdir(parents=True, exist_ok=True)
            left = m.file_size
            with archive.open(m) as source, open(to, "xb") as sink:
                while part := source.read(1 << 20):
                    left -= len(part)
                    if left < 0:
                        raise UnsafeArchiveError(f"{m.filename!r} is longer than it says")
                    sink.write(part)
            if nested and to.suffix.lower() == ".zip":
                folder = to.with_suffix("")
                inner = extract(str(to), str(folder), limits, nested=False)
                to.unlink()
                out += [(folder / x).relative_to(base).as_posix() for x in inner]
            else:
                out.append(to.relative_to(base).as_posix())
    return sorted(out)


def md5_file(path: str) -> str:
    h = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def download(url: str, path: str, md5: str | None = None, timeout: float = 60.0) -> str:
    """Fetch into ``path`` by way of ``path.part``, going on where an earlier attempt stopped; a wrong MD5 removes the file and raises."""
    if os.path.exists(path) and (md5 is None or md5_file(path) == md5):
        return path
    part = f"{path}.part"
    have = os.path.getsize(part) if os.path.exists(part) else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        resumed = have and getattr(response, "status", 200) == 206
        with open(part, "ab" if resumed else "wb") as f:
            while block := response.read(1 << 20):
                f.write(block)
    if md5 is not None and md5_file(part) != md5:
        os.unlink(part)
        raise ValueError(f"{url}: the MD5 isn't {md5}")
    os.replace(part, path)
    return path
