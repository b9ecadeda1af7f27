"""Archives as rows of their members; the only operator over run history that needs Python in the tasks."""

from __future__ import annotations

import io
import posixpath
import re
import stat
import tarfile
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import archive_kind


@dataclass(frozen=True)
class Limits:
    """Bytes and members of one artifact, and levels of archives inside it."""

    bytes: int = 1_000_000_000
    files: int = 100_000
    nesting: int = 8


# Bytes of a name and of a path, and parts of a path, at most; bytes that a joined name keeps; names that a search tool obeys; the name that the manifest takes.
MOST_NAME, MOST_PATH, MOST_PARTS, JOINED = 200, 512, 32, 60
OBEYED, OBEYED_MARK = (".ignore", ".rgignore", ".gitignore"), "~lg"
MANIFEST = "manifest.json"
MEMBER = "path string, inner_path string, archive string, name string, status string, reason string, note string, bytes bigint, content binary"
_NAMES = [x.split(" ")[0] for x in MEMBER.split(", ")]


def _slug(name: str) -> str:
    """As functions.names.slug, for one name."""
    return re.sub("[-.]+$", "", re.sub("^[-.]+|[-.]+$", "", re.sub("[^A-Za-z0-9.]+", "-", name))[:60]) or "none"


def _fold(name: str) -> str:
    """One text for all names that a file system may take for one."""
    return unicodedata.normalize("NFC", name).lower()


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _safe_part(part: str, last: bool) -> tuple[str, str]:
    """A part as it can be written, and why it differs."""
    if any(c < " " or c == "\x7f" or "\ud800" <= c <= "\udfff" for c in part):
        return _slug(part), "invalid"
    if _bytes(part) > MOST_NAME:
        return _slug(part), "too_long"
    return (part + OBEYED_MARK, "rg_ignore_file") if last and _fold(part) in OBEYED else (part, "")


def _safe_parts(name: str, below: str = "") -> tuple[list[str], str, str]:
    """Parts of a member's name, why it has none, and the first reason for which they differ from the name; `below`: the folder that its archive goes into."""
    if name.startswith("/"):
        return [], "absolute", ""
    clean = posixpath.normpath(name)
    if clean.split("/")[0] == "..":
        return [], "outside", ""
    if clean == ".":
        return ["none"], "", "invalid"
    notes = [] if clean == re.sub(r"^(\./)+|/$", "", name) else ["normalized"]
    parts = clean.split("/")
    made = [_safe_part(part, i == len(parts)) for i, part in enumerate(parts, 1)]
    notes += [why for _, why in made if why]
    parts = [part for part, _ in made]
    base = below.split("/") if below else []
    if len(base) + len(parts) > MOST_PARTS:
        keep, why = MOST_PARTS - len(base) - 1, "too_deep"
        parts, notes = [*parts[:keep], _slug("/".join(parts[keep:]))], [*notes, why]
    if _bytes("/".join([*base, *parts])) > MOST_PATH:
        fits = [k for k in range(len(parts)) if _bytes("/".join([*base, *parts[:k]])) + 1 + JOINED <= MOST_PATH]
        keep = max(fits, default=0)
        parts, notes = [*parts[:keep], _slug("/".join(parts[keep:]))], [*notes, "too_long"]
    return parts, "", next(iter(notes), "")


class _Names:
    """Names given so far in each folder. A file takes no name that a file or a folder there has, whatever its case or composition, and neither does a new
    folder; ~1, ~2, ... come behind the whole name. Members of one folder meet in it again, renamed or not."""

    def __init__(self, below: str = "") -> None:
        self.taken = set() if below else {("", _fold(MANIFEST))}
        self.folders: dict[tuple[str, str], str] = {}
        self.tried: dict[tuple[str, str], int] = {}

    def _fresh(self, folder: str, name: str) -> str:
        key, given = (folder, _fold(name)), name
        while (folder, _fold(given)) in self.taken:
            n = self.tried[key] = self.tried.get(key, 0) + 1
            mark = f"~{n}"
            given = name.encode("utf-8", "surrogatepass")[: MOST_NAME - len(mark)].decode("utf-8", "ignore") + mark
        self.taken.add((folder, _fold(given)))
        return given

    def take(self, parts: list[str]) -> str:
        at = ""
        for part in parts[:-1]:
            if (at, part) not in self.folders:
                self.folders[at, part] = self._fresh(at, part)
            at = posixpath.join(at, self.folders[at, part])
        return posixpath.join(at, self._fresh(at, parts[-1]))


def _zip_members(content: bytes) -> Iterator[tuple[str, str, int, Callable[[int], bytes]]]:
    """Name, why it is left out, mode, and a reader of so many bytes at most of each member."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            mode = info.external_attr >> 16
            if info.is_dir():
                if info.file_size:
                    yield info.filename, "dir_with_data", mode, lambda n: b""
            elif stat.S_ISLNK(mode):
                yield info.filename, "symlink", mode, lambda n: b""
            elif mode and not stat.S_ISREG(mode) and stat.S_IFMT(mode):
                yield info.filename, "special", mode, lambda n: b""
            else:

                def read(n: int, info: zipfile.ZipInfo = info) -> bytes:
                    with z.open(info) as f:
                        return f.read(n)

                yield info.filename, "", mode, read


def _tar_members(content: bytes) -> Iterator[tuple[str, str, int, Callable[[int], bytes]]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
        for info in t:
            why = "symlink" if info.issym() else "hardlink" if info.islnk() else "device" if info.ischr() or info.isblk() else "fifo" if info.isfifo() else ""
            if not info.isdir():
                yield info.name, why if why or info.isreg() else "special", info.mode, lambda n, info=info: (t.extractfile(info) or io.BytesIO()).read(n)


def _expand(path: str, archive: str, content: bytes, limits: Limits) -> Iterator[tuple]:
    """Rows of one archive, as its members are read; a broken one ends with a row that says so.

    No member is read beyond the bytes that are left, so what a small archive unpacks to doesn't matter.
    """
    below = f"{archive}.d" if archive else ""
    names, total, files = _Names(below), 0, 0
    try:
        for name, why, mode, read in _zip_members(content) if content[:4] == b"PK\x03\x04" else _tar_members(content):
            parts, bad, note = _safe_parts(name, below)
            if not (why or bad):
                try:
                    data = read(limits.bytes - total + 1)
                except (zipfile.BadZipFile, zlib.error, ValueError, NotImplementedError, RuntimeError):
                    why = "corrupt"
            if why or bad:
                yield path, name, archive, name, "skipped", why or bad, None, 0, None
                continue
            total, files = total + len(data), files + 1
            if total > limits.bytes:
                yield path, None, archive, None, "rejected", "too many bytes", None, total, None
                return
            if files > limits.files:
                yield path, None, archive, None, "not_expanded", "too many files", None, 0, None
                return
            given = names.take(parts)
            note = note or ("collision" if given != "/".join(parts) else "")
            notes = [note, "setuid_dropped" if mode & 0o6000 else ""]
            yield path, posixpath.join(below, given), archive, name, "extracted", None, ",".join(filter(None, notes)) or None, len(data), data
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, zlib.error) as e:
        if files:
            yield path, None, archive, None, "not_expanded", "partial", None, 0, None
        else:
            yield path, None, archive, None, "rejected", f"corrupt: {type(e).__name__}", None, 0, None


def expand_once(archives: DataFrame, limits: Limits) -> DataFrame:
    """Members of each row's archive: path, archive (inside the artifact, '' at the top), content → MEMBER. One archive is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found: list[tuple] = []
                size = 0
                for member in _expand(row["path"], row["archive"], row["content"], limits):
                    found.append(member)
                    size += len(member[-1] or b"")
                    if size > 1 << 22 or len(found) >= 256:
                        yield _batch(found)
                        found, size = [], 0
                if found:
                    yield _batch(found)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    return archives.select("path", "archive", "content").mapInArrow(run, MEMBER)


def _cut(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder if it has one, so that no later step unpacks an archive again."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df


def expand(artifacts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All members of artifacts (path, content), nested archives beside themselves as name.d/.

    What is an archive is told by its first bytes alone. Each level is a pass over the archives that the one before found, so
    nested work spreads over tasks; what lies deeper than `nesting` levels has a row that says so. An artifact over its
    bytes, at any level, is rejected as a whole; of a damaged archive the members before the damage stay.
    """
    found = _cut(expand_once(artifacts.select("path", F.lit("").alias("archive"), "content"), limits))
    members = found
    for depth in range(1, limits.nesting + 2):
        nested = found.where((F.col("status") == "extracted") & archive_kind(F.col("content")).isNotNull())
        if nested.isEmpty():
            break
        if depth > limits.nesting:
            none = F.lit(None)
            deep = nested.select("path", none.cast("string").alias("inner_path"), F.col("inner_path").alias("archive"), none.cast("string").alias("name"), F.lit("not_expanded").alias("status"), F.lit("nesting").alias("reason"), none.cast("string").alias("note"), F.lit(0).cast("bigint").alias("bytes"), none.cast("binary").alias("content"))
            members = members.unionByName(deep)
            break
        found = _cut(expand_once(nested.select("path", F.col("inner_path").alias("archive"), "content"), limits))
        members = members.unionByName(found)
    bad = (F.col("status") == "rejected") & ((F.col("archive") == "") | (F.col("reason") == "too many bytes"))
    over = members.select("path", "bytes", bad.alias("bad")).groupBy("path").agg(F.sum("bytes").alias("all"), F.bool_or("bad").alias("bad")).where((F.col("all") > limits.bytes) | F.col("bad"))
    kept = members.join(over.select("path"), "path", "left_anti")
    values = {"archive": F.lit(""), "status": F.lit("rejected"), "reason": F.lit("artifact rejected"), "bytes": F.col("all")}
    return kept.unionByName(over.select("path", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ") for x in MEMBER.split(", ")[1:])]))


def manifest(members: DataFrame) -> DataFrame:
    """Per artifact: how many members were extracted, and lists of those that were renamed, lost their setuid bits, were skipped or not expanded."""
    listed = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("inner_path", "reason"))))
    noted = lambda has: F.array_sort(F.collect_list(F.when(has, F.struct("archive", "name", "inner_path", "note"))))
    setuid = F.coalesce(F.col("note").contains("setuid_dropped"), F.lit(False))
    renamed = F.coalesce(F.col("note") != "setuid_dropped", F.lit(False))
    return members.groupBy("path").agg(
        F.count_if(F.col("status") == "extracted").alias("extracted"), noted(renamed).alias("renamed"), noted(setuid).alias("setuid_dropped"), listed("skipped").alias("skipped"), listed("not_expanded").alias("not_expanded"), listed("rejected").alias("rejected")
    )
