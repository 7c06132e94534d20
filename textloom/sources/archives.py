"""Archives with a pickled index, and compiled containers with slots. Nothing that bytes name is ever called."""

from __future__ import annotations

import base64
import binascii
import io
import pickle
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.batching import bounded

ENTRIES = "path string, name string, offset long, length long, prefix binary, error string"


class _Plain(pickle.Unpickler):
    """Containers and scalars only."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def safe_name(name: str) -> bool:
    """No absolute path and no way out of the folder."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and parts[0] != "" and ".." not in parts and ":" not in parts[0]


def index(content: bytes) -> dict[str, tuple[int, int, bytes]]:
    """name -> (offset, length, prefix); of several entries of a name the last."""
    if content.startswith(b"RPA-3.0 "):
        at, key = int(content[8:24], 16), int(content[25:33], 16)
    elif content.startswith(b"RPA-2.0 "):
        at, key = int(content[8:24], 16), 0
    else:
        raise ValueError("not an archive of version 2 or 3")
    raw = zlib.decompress(content[at:])
    out = {}
    for name, entries in _Plain(io.BytesIO(raw)).load().items():
        if entries:
            offset, length, *rest = entries[-1]
            prefix = rest[0] if rest else b""
            out[name] = (offset ^ key, length ^ key, prefix if isinstance(prefix, bytes) else (prefix or "").encode("latin-1"))
    return out


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def entries(files: DataFrame) -> DataFrame:
    """ENTRIES of every (path, content); a file that cannot be read is one row with its error. Unsafe names are errors too."""
    import pandas as pd

    names = [part.split()[0] for part in ENTRIES.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    for name, (offset, length, prefix) in index(bytes(content)).items():
                        rows.append((path, name, offset, length, prefix, None if safe_name(name) else "unsafe name"))
                except Exception as error:  # a broken archive is a row, not the end of the job
                    rows.append((path, None, None, None, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    bounded(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, ENTRIES)


def contents(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, name, content) of entries, cut from the archives' bytes.

    The wanted entries of an archive meet its bytes as one list, so each archive travels once at most; the task
    that holds it cuts them one after another.
    """
    wanted = found.where("error is null").groupBy("path").agg(F.collect_list(F.struct("name", "offset", "length", "prefix")).alias("entries"))

    def cut(frames):
        import pandas as pd

        for frame in frames:
            for path, content, entries in zip(frame["path"], frame["content"], frame["entries"]):
                for e in entries:
                    body = bytes(content[e["offset"] : e["offset"] + e["length"]])
                    yield pd.DataFrame({"path": [path], "name": [e["name"]], "content": [bytes(e["prefix"] or b"") + body]})

    bounded(files.sparkSession)
    return files.select("path", "content").join(wanted, "path").mapInPandas(cut, "path string, name string, content binary")


def scripts_only(found: DataFrame) -> DataFrame:
    return found.where(F.rlike(F.lower("name"), F.lit(r"\.(rpym?c?)$")))


def preferred(found: DataFrame, *, compiled_first: bool = True) -> DataFrame:
    """One entry of each stem and family (plain or module), compiled or source form first."""
    from ..operators.keys import keep_first

    low = F.lower("name")
    rows = found.withColumn("_stem", F.regexp_replace(low, r"\.rpym?c?$", "")).withColumn("_family", F.rlike(low, F.lit(r"\.rpymc?$"))).withColumn("_compiled", F.rlike(low, F.lit("c$")))
    return keep_first(rows, ["_stem", "_family"], [F.desc("_compiled") if compiled_first else F.asc("_compiled"), F.desc("path"), "name"]).drop("_stem", "_family", "_compiled")


def slot(content: bytes, number: int = 1, *, magic: int = 10) -> bytes:
    """The inflated slot of a compiled container: after the magic, triples of (slot, start, length) until slot 0. Bare zlib data is slot 1."""
    if content[:1] == b"x":
        return zlib.decompress(content)
    at = magic
    while at + 12 <= len(content):
        which, start, length = struct.unpack("<III", content[at : at + 12])
        if which == 0:
            break
        if which == number:
            return zlib.decompress(content[start : start + length])
        at += 12
    raise ValueError(f"no slot {number}")


def inflated(content: bytes) -> bytes:
    """slot(), else the first zlib stream found anywhere."""
    try:
        return slot(content)
    except (ValueError, zlib.error, struct.error):
        pass
    at = -1
    while (at := content.find(b"x", at + 1)) >= 0:
        try:
            return zlib.decompressobj().decompress(content[at:])
        except zlib.error:
            continue
    raise ValueError("no compressed data")


def layers(data: bytes, rounds: int = 10) -> tuple[bytes, list[str]]:
    """data with zlib, hexadecimal, base64 and string-escape layers taken off while one applies."""
    seen = []
    for _ in range(rounds):
        for name, decode in (("zlib", zlib.decompress), ("hex", lambda b: binascii.unhexlify(b.strip())), ("base64", lambda b: base64.b64decode(b.strip(), validate=True)), ("escape", _unescape)):
            try:
                out = decode(data)
            except Exception:
                continue
            if out and out != data:
                data = out
                seen.append(name)
                break
        else:
            break
    return data, seen


def _unescape(data: bytes) -> bytes:
    if b"\\x" not in data:
        raise ValueError("no escapes")
    return data.decode("unicode_escape").encode("latin-1")


def decoded(files: DataFrame) -> DataFrame:
    """(path, content, layers, state, error) of compiled files: ok, bad_header or error."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out, seen = layers(inflated(bytes(content)))
                    rows.append((path, out, seen, "ok", None))
                except ValueError as error:
                    rows.append((path, None, [], "bad_header", str(error)))
                except Exception as error:
                    rows.append((path, None, [], "error", str(error)[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "layers", "state", "error"], dtype=object)

    bounded(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, content binary, layers array<string>, state string, error string")


def byte_counts(files: DataFrame) -> DataFrame:
    """(path, counts): how often each of the 256 bytes stands in a content; null and empty contents have none."""

    def run(frames):
        for frame in frames:
            frame["counts"] = [np.bincount(np.frombuffer(c or b"", np.uint8), minlength=256).tolist() for c in frame.pop("content")]
            yield frame

    bounded(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, counts array<long>")
