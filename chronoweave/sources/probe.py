"""Telemetry files: which format a file's bytes look like, and its MP4 sample table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: marks that formats put into a file. Any of them will do, but all of "dji", and that of "insta360" is a file's end.
MARKS = (("gopro", ("GoPro MET", "GoPro SOS", "GPMFDEVC")), ("insta360", ("8db42d694ccc418790edff439fe026bf",)), ("dji", ("CAM meta", "djmd")), ("sony", ("Non-Real Time Meta", "manufacturer=\"Sony\"")), ("gcsv", (" IMU LOG",)))


def window_bytes(size: Column) -> Column:
    """How much of a file's head and tail is looked at, by its size."""
    mb = 1 << 20
    return F.when(size < 100 * mb, 5 * mb).when(size < 1000 * mb, 50 * mb).otherwise(500 * mb)


def sniff(content: Column) -> Column:
    """The first format whose marks are in the bytes (a file's, or its head and tail), else null."""
    text = F.decode(content, "ISO-8859-1")
    out = F.lit(None).cast("string")
    for name, marks in reversed(MARKS):
        hits = [F.endswith(text, F.lit(m)) if name == "insta360" else text.contains(m) for m in marks]
        hit = hits[0]
        for h in hits[1:]:
            hit = hit & h if name == "dji" else hit | h
        out = F.when(hit, name).otherwise(out)
    return out


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of files; bytes are read by Spark's binary source."""
    files = spark.read.format("binaryFile").load(path)
    most = window_bytes(F.col("length"))
    seen = F.concat(F.substring("content", F.lit(1), most), F.substring("content", F.greatest(F.lit(1), F.col("length") - most + 1).cast("int"), most))
    return files.select("path", "length", sniff(seen).alias("format"))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the MP4 boxes in a range; a box that overruns it ends the walk."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, head = struct.unpack_from(">I", data, at)[0], 8
        kind = data[at + 4 : at + 8].decode("latin1")
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def sample_table(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """(offset, size, duration) of each sample of a sample-table box: run lengths expanded,
    chunks laid out, durations by run."""
    found = {kind: data[a:b] for kind, a, b in boxes(data, start, end)}

    def table(kind: str, form: str, skip: int = 8) -> list[tuple]:
        body = found.get(kind, b"")
        width = struct.calcsize(form)
        return [struct.unpack_from(form, body, p) for p in range(skip, len(body) - width + 1, width)]

    same, count = struct.unpack_from(">II", found["stsz"], 4) if "stsz" in found else (0, 0)
    sizes = [same] * count if same else [s for (s,) in table("stsz", ">I", 12)][:count]
    chunks = [o for (o,) in table("co64", ">Q")] or [o for (o,) in table("stco", ">I")]
    durations = [d for n, d in table("stts", ">II") for _ in range(n)]
    runs = table("stsc", ">III")
    out, k = [], 0
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for c in range(first - 1, min(last - 1, len(chunks))):
            at = chunks[c]
            for _ in range(per):
                if k >= len(sizes):
                    return out
                out.append((at, sizes[k], durations[k] if k < len(durations) else 0))
                at += sizes[k]
                k += 1
    return out


def klv(data: bytes) -> Iterator[tuple[str, str, list]]:
    """(key, kind, values) of a GPMF stream; nested keys are walked through, unknown kinds give bytes."""
    forms = {"b": "b", "B": "B", "s": "h", "S": "H", "l": "i", "L": "I", "f": "f", "d": "d", "j": "q", "J": "Q"}
    at = 0
    while at + 8 <= len(data):
        key, kind, size, n = data[at : at + 4].decode("latin1"), chr(data[at + 4]), data[at + 5], struct.unpack_from(">H", data, at + 6)[0]
        body = data[at + 8 : at + 8 + size * n]
        at += 8 + -(-size * n // 4) * 4
        if kind == "\0":
            yield key, kind, []
            yield from klv(body)
        elif kind == "c":
            yield key, kind, [body.rstrip(b"\0").decode("latin1")]
        elif kind in forms:
            width = struct.calcsize(forms[kind])
            yield key, kind, list(struct.unpack(f">{len(body) // width}{forms[kind]}", body[: len(body) // width * width]))
        else:
            yield key, kind, [body]


def natural_key(name: Column) -> Column:
    """An image-sequence name's number, for numeric order."""
    return F.regexp_extract(name, r"([0-9]+)(?:\.[^.]*)?$", 1).try_cast("long")


def read_klv(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, seq, key, kind, values) of GPMF payloads."""

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, i, k, t, [str(v) for v in vs]) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, (k, t, vs) in enumerate(klv(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "seq", "key", "kind", "values"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(fn, "path string, seq int, key string, kind string, values array<string>")
