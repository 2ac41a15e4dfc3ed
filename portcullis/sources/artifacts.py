"""Uploaded artifacts: what their bytes are and what loading them would run.

Files come from ``binaryFile``; each is looked at by a helper in batches that never unpickles. A pickle is
what can be walked, opcode by opcode, to a stop, whatever its first byte; archives and compressed streams
are opened member by member under one budget of bytes, and what they hold is looked at the same way. What
can't be identified or opened is refused, unless ``reject_unparseable`` is off: then it is a warning.
"""

from __future__ import annotations

import bz2
import io
import json
import lzma
import pickletools
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of unpacking; modules and names that mean code in a pickle, and those that don't.
DEPTH, ENTRIES, MEMBER_BYTES, RATIO, CAP = 3, 2000, 16 << 20, 200, 512 << 20
DENIED = frozenset(
    "os posix nt subprocess sys socket shutil pty ctypes runpy importlib webbrowser urllib urllib2 http httplib requests pickle cPickle marshal code codeop "
    "multiprocessing threading asyncio signal commands popen2 platform pdb bdb timeit tempfile glob ftplib smtplib telnetlib pip setuptools distutils".split()
)
DENIED_BUILTINS = frozenset("eval exec execfile compile __import__ open file input getattr setattr delattr globals locals vars breakpoint apply memoryview".split())
SAFE_BUILTINS = frozenset("set frozenset slice range complex bytearray bytes dict list tuple int float bool str object type".split())
SAFE = frozenset(
    "collections.OrderedDict collections.defaultdict collections.Counter _codecs.encode copyreg._reconstructor copy_reg._reconstructor torch._utils._rebuild_tensor_v2 "
    "torch._utils._rebuild_tensor torch._utils._rebuild_parameter torch._tensor._rebuild_from_type_v2 torch.Size torch.nn.parameter.Parameter "
    "numpy.core.multiarray._reconstruct numpy._core.multiarray._reconstruct numpy.core.multiarray.scalar numpy._core.multiarray.scalar numpy.ndarray numpy.dtype".split()
)
SAFE_PATTERN = re.compile(r"torch\.(?:(?:Float|Double|Half|BFloat16|Long|Int|Short|Char|Byte|Bool|Complex\w*)Storage|(?:float|int|uint|bool|bfloat|complex)\d*)")
LEVELS = ("info", "warn", "block")
# What a file's name promises, and names of members that are looked at whatever they hold.
PROMISED = {"safetensors": {"safetensors"}, "gguf": {"gguf"}, "npy": {"npy"}, "pkl": {"pickle"}, "pickle": {"pickle"}, "pt": {"zip", "pickle"}, "pth": {"zip", "pickle"}, "zip": {"zip"}}
LOADED = ("pkl", "pickle", "pt", "pth", "bin", "ckpt", "joblib")
#: Opcodes by which a pickle gets at code.
NAMING = {"GLOBAL", "INST", "STACK_GLOBAL", "EXT1", "EXT2", "EXT4"}
#: First bytes of formats, and what undoes compressed streams a piece at a time (none: the content stays closed).
MARKS = {b"PK\x03\x04": "zip", b"PK\x05\x06": "zip", b"7z\xbc\xaf\x27\x1c": "7z", b"Rar!": "rar", b"GGUF": "gguf", b"\x93NUMPY": "npy", b"\x89HDF": "hdf5"}
PACKED = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ\0": lzma.LZMADecompressor, b"\x28\xb5\x2f\xfd": None}
OPENED = {"pickle", "zip", "tar", "7z", "rar", "compressed", "npy"}
#: Bytes given to a decompressor at a time, bytes walked before a walk without a mark is given up as text, pickles of a file.
PIECE, STREAMS = 1 << 16, 10_000
#: Files whose contents or findings are held beside a batch.
ROWS = 256

Found = tuple[str, str, str]


@dataclass
class Budget:
    """What one file may unpack to, and the feed's signatures of names (``module.name`` or ``module`` -> id)."""

    signatures: dict[str, str] = field(default_factory=dict)
    reject_unparseable: bool = True
    entries: int = ENTRIES
    left: int = CAP

    def closed(self, code: str, detail: str) -> Found:
        """Something that couldn't be read."""
        return ("block" if self.reject_unparseable else "warn", code, detail)


# Pickles -----------------------------------------------------------------------------------------


def _names(stream: io.BytesIO) -> Iterator[tuple[str, str] | None]:
    """(module, name) of all that one pickle names, None where they aren't plain strings. The stack is followed
    by the opcodes' own descriptions, with strings as values and None for all else. Raises where the stream breaks off."""
    stack: list = []
    memo: dict[int, object] = {}
    mark = object()
    for op, arg, _ in pickletools.genops(stream):
        if op.name == "STACK_GLOBAL":
            below = [x for x in stack[-2:] if isinstance(x, str)]
            yield (below[0], below[1]) if len(below) == 2 else None
        elif op.name in ("GLOBAL", "INST"):
            module, _, name = str(arg).partition(" ")
            yield module, name
        elif op.name == "MEMOIZE":
            memo[len(memo)] = stack[-1] if stack else None
            continue
        elif op.name.endswith("PUT"):
            memo[int(arg)] = stack[-1] if stack else None
            continue
        if op.name == "DUP":
            stack.append(stack[-1] if stack else None)
            continue
        if pickletools.markobject in op.stack_before:
            while stack and stack.pop() is not mark:
                pass
            for _ in range(op.stack_before.index(pickletools.markobject)):
                stack and stack.pop()
        else:
            for _ in op.stack_before:
                stack and stack.pop()
        for out in op.stack_after:
            if out is pickletools.markobject:
                stack.append(mark)
            elif op.name.endswith("GET"):
                stack.append(memo.get(int(arg)))
            else:
                stack.append(arg.decode("latin-1") if isinstance(arg, bytes) else arg if isinstance(arg, str) else None)


def _judged(named: tuple[str, str] | None, signatures: dict[str, str]) -> Found:
    """What it means that a pickle names something."""
    if named is None:
        return "warn", "unresolved_global", "operands unknown"
    module, name = named
    full, root = f"{module}.{name}", module.split(".")[0]
    if by := next((signatures[x] for x in (full, module, root) if x in signatures), None):
        return "block", "feed_signature", f"{full} ({by})"
    if root in ("builtins", "__builtin__"):
        first = name.split(".")[0]
        return ("block", "dangerous_global", full) if first in DENIED_BUILTINS else ("info", "global", full) if name in SAFE_BUILTINS else ("warn", "unknown_global", full)
    if root in DENIED:
        return "block", "dangerous_global", full
    return ("info", "global", full) if full in SAFE or SAFE_PATTERN.fullmatch(full) else ("warn", "unknown_global", full)


def _pickles(data: bytes, budget: Budget) -> Iterator[Found]:
    """What all pickles of a file name, one after another: each is loaded by a reader that goes on. What was
    named before a stream breaks off counts."""
    stream, number = io.BytesIO(data), 0
    while stream.tell() < len(data):
        if number == STREAMS:
            yield budget.closed("unparseable_pickle", f"more than {STREAMS} pickles")
            return
        try:
            for named in _names(stream):
                yield _judged(named, budget.signatures)
        except Exception as error:  # noqa: BLE001  broken streams raise errors of many kinds
            yield ("warn", "trailing_data", type(error).__name__) if number else budget.closed("unparseable_pickle", type(error).__name__)
            return
        number += 1


def _walks(data: bytes) -> bool:
    """Whether opcodes lead from the first byte to a stop: pickles of protocols 0 and 1, and those whose mark
    was left out, have no first bytes of their own.

    A text may begin like a pickle of a number or a string. It is one only if something is named before a stop, or
    if pickles fill it to its end. Up to the first name an opcode must find what it takes, and that name has no
    blanks: no reader goes on without that.
    """
    stream, named = io.BytesIO(data), False
    for number in range(STREAMS):
        depth, marks = 0, []
        try:
            for op, arg, _ in pickletools.genops(stream):
                if named:
                    continue
                if op.name in NAMING:
                    if op.name in ("GLOBAL", "INST") and str(arg).count(" ") > 1:
                        return False
                    named = True
                    continue
                taken = len(op.stack_before)
                if pickletools.markobject in op.stack_before:
                    if not marks:
                        return False
                    depth, taken = marks.pop(), op.stack_before.index(pickletools.markobject)
                if taken > depth:
                    return False
                depth -= taken
                while marks and marks[-1] >= depth:
                    marks.pop()
                if pickletools.markobject in op.stack_after:
                    marks.append(depth)
                depth += len(op.stack_after)
        except Exception:  # noqa: BLE001  then it is none, unless a reader was given one before
            return named and number > 0
        if named or stream.tell() == len(data):
            return True
    return True


# Formats -----------------------------------------------------------------------------------------


def _tensors(data: bytes) -> bool:
    size = int.from_bytes(data[:8], "little")
    if not (2 <= size <= len(data) - 8 and data[8:9] == b"{"):
        return False
    try:
        return isinstance(json.loads(data[8 : 8 + size].decode()), dict)
    except ValueError:
        return False


def sniff(data: bytes) -> str:
    """The format by content, never by name."""
    for first, kind in MARKS.items():
        if data.startswith(first):
            return kind
    if data[257:262] == b"ustar":
        return "tar"
    if any(data.startswith(first) for first in PACKED) or _zlib(data):
        return "compressed"
    if _tensors(data):
        return "safetensors"
    return "pickle" if (data[:1] == b"\x80" and len(data) > 2 and 2 <= data[1] <= 5) or _walks(data) else "unknown"


def _zlib(data: bytes) -> bool:
    """A bare zlib stream: its two first bytes check one another, and it begins to unpack."""
    if len(data) < 6 or data[0] & 15 != 8 or data[0] >> 4 > 7 or (data[0] << 8 | data[1]) % 31 or data[1] & 32:
        return False
    try:
        return bool(zlib.decompressobj().decompress(data[:PIECE], 1))
    except zlib.error:
        return False


def _parts(data: bytes) -> Iterator[bytes]:
    """What all streams of a compressed file hold, as their readers join it, a piece at a time. What follows
    the last stream and is none is left out."""
    at = 0
    while at < len(data):
        make = next((m for first, m in PACKED.items() if data.startswith(first, at)), zlib.decompressobj if at == 0 else None)
        if make is None:
            return
        one = make()
        while at < len(data) and not one.eof:
            rest = data[at : at + PIECE]
            at += len(rest)
            while rest:
                yield one.decompress(rest, PIECE)
                while not one.eof and not getattr(one, "needs_input", True):  # it keeps the rest itself
                    yield one.decompress(b"", PIECE)
                rest = b"" if one.eof else getattr(one, "unconsumed_tail", b"")
        if not one.eof and hasattr(one, "flush"):
            yield one.flush()
        at -= len(one.unused_data)
        while data[at : at + 1] == b"\0":  # padding between streams
            at += 1


def _unpacked(data: bytes, budget: Budget) -> bytes | None:
    """The content of a compressed file; None as soon as it is beyond the budget."""
    out = bytearray()
    for part in _parts(data):
        out += part
        if len(out) > budget.left or (len(out) > MEMBER_BYTES and len(out) > RATIO * len(data)):
            return None
    budget.left -= len(out)
    return bytes(out)


def findings(data: bytes, name: str = "", budget: Budget | None = None, depth: int = 0) -> Iterator[Found]:
    """(level, code, detail) of everything that is found. Content that no format claims is refused at the top
    only: inside an archive it is ordinary data."""
    budget = budget or Budget()
    if not data:
        if depth == 0:
            yield budget.closed("empty", name)
        return
    if depth > DEPTH:
        yield "block", "archive_too_deep", name
        return
    kind, last = sniff(data), name.rsplit("/", 1)[-1]
    if last.rpartition(".")[1] and kind not in PROMISED.get(last.rpartition(".")[2].lower(), {kind}):
        yield "warn", "extension_mismatch", f"{name} holds {kind}"
    if kind == "pickle":
        yield "warn", "pickle_format", name
        yield from _pickles(data, budget)
    elif kind == "npy":
        yield from _array(data, name, budget)
    elif kind == "compressed":
        yield from _compressed(data, name, budget, depth)
    elif kind in ("zip", "tar"):
        yield from _members(data, kind, name, budget, depth)
    elif kind in ("7z", "rar"):
        yield "block", "unsupported_archive", kind
    elif kind == "hdf5":
        yield "warn", "format_not_inspected", kind
    elif kind == "unknown" and depth == 0:
        yield budget.closed("unknown_format", name)


def _array(data: bytes, name: str, budget: Budget) -> Iterator[Found]:
    """An array of objects is a pickle behind its header."""
    wide = 2 if data[6:7] == b"\x01" else 4
    start = 8 + wide + int.from_bytes(data[8 : 8 + wide], "little")
    header = data[8 + wide : start]
    if len(data) < start:
        yield budget.closed("unparseable_npy", name)
    elif b"'O'" in header or b"|O" in header:
        yield "warn", "pickle_format", name
        yield from _pickles(data[start:], budget)


def _compressed(data: bytes, name: str, budget: Budget, depth: int) -> Iterator[Found]:
    """A compressed archive is opened as one. Any other compressed file is refused, and what it holds told beside that."""
    inner = b""
    if not data.startswith(b"\x28\xb5\x2f\xfd"):
        try:
            inner = _unpacked(data, budget)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError) as error:
            yield budget.closed("bad_archive", type(error).__name__)
    if inner is None:
        yield "block", "decompression_bomb", name
    elif inner and sniff(inner) == "tar":
        yield from _members(inner, "tar", name, budget, depth)
    else:
        yield "block", "unsupported_archive", name
        if inner and sniff(inner) in OPENED:
            yield from findings(inner, "", budget, depth + 1)


def _unsafe(path: str) -> bool:
    return path.startswith(("/", "\\")) or path[1:2] == ":" or ".." in re.split(r"[/\\]", path)


def _members(data: bytes, kind: str, name: str, budget: Budget, depth: int) -> Iterator[Found]:
    """Each member of an archive, read only where its declared size is within the budget."""
    try:
        if kind == "zip":
            archive = zipfile.ZipFile(io.BytesIO(data))
            members = [(m.filename, m.file_size, not m.is_dir(), False, lambda m=m: archive.open(m)) for m in archive.infolist()]
        else:
            archive = tarfile.open(fileobj=io.BytesIO(data))
            members = [(m.name, m.size, m.isfile(), m.issym() or m.islnk(), lambda m=m: archive.extractfile(m)) for m in archive.getmembers()]
    except Exception as error:  # noqa: BLE001  broken archives raise errors of many kinds
        yield budget.closed("bad_archive", type(error).__name__)
        return
    declared = sum(m[1] for m in members if m[2])
    if len(members) > budget.entries:
        yield "block", "too_many_entries", str(len(members))
        return
    if declared > budget.left or (kind == "zip" and declared > MEMBER_BYTES and declared > RATIO * len(data)):
        yield "block", "decompression_bomb", f"{name} holds {declared} bytes"
        return
    for path, _, is_file, link, opened in members:
        if link or _unsafe(path):
            yield "block", "path_traversal", path
            continue
        if not is_file:
            continue
        try:
            with opened() as file:
                member = file.read(budget.left + 1)
        except Exception as error:  # noqa: BLE001  wrong sums, unknown methods, passwords
            yield budget.closed("bad_archive", f"{path}: {type(error).__name__}")
            continue
        budget.left -= len(member)
        if budget.left < 0:
            yield "block", "decompression_bomb", path
            return
        if path.rpartition(".")[2].lower() in LOADED or sniff(member) in OPENED:
            for level, code, detail in findings(member, path, budget, depth + 1):
                yield level, code, detail if detail.startswith(path) else f"{path}: {detail}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def scan(artifacts: DataFrame, signatures: dict[str, str] | None = None, reject_unparseable: bool = True, entries: int = ENTRIES, unpacked: int = CAP) -> DataFrame:
    """A row for each finding: path, level, code, detail; null contents have none. ``signatures`` are those of
    a feed of names, small by nature."""

    names = ["path", "level", "code", "detail"]
    schema = pa.schema([(name, pa.string()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                # One file's content at a time is taken out of the batch.
                rows = [
                    dict(zip(names, (p, *f), strict=True)) for p, c in zip(some.column("path").to_pylist(), some.column("content"), strict=True) if c.is_valid
                    for f in findings(c.as_py(), p or "", Budget(signatures or {}, reject_unparseable, entries, unpacked))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return artifacts.select("path", "content").mapInArrow(run, "path string, level string, code string, detail string")


def verdicts(artifacts: DataFrame, banned: DataFrame, profile_action: str = "block", block_on_warn: bool = False, most: int = 20, **limits) -> DataFrame:
    """The action for each artifact: a banned digest or a block finding has the profile's, a warning is
    flagged (or has it too), with up to ``most`` findings as text, the worst first, and all codes."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    said = F.collect_set(F.when(rank > 1, F.struct((-rank).alias("order"), F.substring(F.concat_ws(" ", "code", "detail"), 1, 120).alias("said"))))
    found = scan(artifacts, **limits).groupBy("path").agg(
        F.max(rank).alias("rank"), F.slice(F.sort_array(said), 1, most)["said"].alias("findings"), F.array_join(F.sort_array(F.collect_set(F.when(rank > 1, F.col("code")))), ",").alias("codes")
    )
    bad = banned.select(F.lower("sha256").alias("sha256")).distinct().withColumn("__bad", F.lit(True))
    hashed = artifacts.select("path", F.sha2("content", 256).alias("sha256")).join(bad, "sha256", "left")
    worst = F.coalesce("rank", F.lit(1))
    action = F.when(F.col("__bad") | (worst == 3), profile_action).when((worst == 2) & (F.lit(profile_action) != "allow"), profile_action if block_on_warn else "flag").otherwise("allow")
    return hashed.join(found, "path", "left").select("path", "sha256", action.alias("action"), "findings", F.coalesce("codes", F.lit("")).alias("codes"))
