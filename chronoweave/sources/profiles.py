"""Profiles and projects in files: trees of JSON, zipped CBOR bundles, their order, and projects that keep what they don't know."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import codecs
from chronoweave.operators import catalog
from chronoweave.runtime import ensure_shipped

#: Of each profile: its key, where it came from, its JSON text, whether it is only a name.
SCHEMA = "key string, path string, profile string, stub boolean"


def tree(spark: SparkSession, root: str, stub_ending: str = ".preset") -> DataFrame:
    """``SCHEMA`` of a folder's JSON files at any depth, without hidden files and folders. The key is a profile's own
    identifier, else the path below the folder; files with ``stub_ending`` are profiles by name only, with
    a checksum of their path. Files that aren't JSON are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{.json,{stub_ending}}}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    # a file system may write its scheme with one slash or three
    below = F.regexp_replace(F.regexp_replace("path", r"^([a-z]+):/+", "$1:/"), F.lit("^" + _quoted(base)), F.lit(""))
    rows = files.select("path", below.alias("below"), F.decode("content", "UTF-8").alias("text")).where(~F.col("below").rlike(r"(^|/)\."))
    stub = F.endswith("path", F.lit(stub_ending))
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    own = F.nullif(F.get_json_object("text", "$.identifier"), F.lit(""))
    made = F.to_json(F.struct(name.alias("name"), F.lpad(F.lower(F.hex(F.crc32(F.col("path").cast("binary")))), 8, "0").alias("checksum")))
    good = rows.where(stub | F.try_parse_json("text").isNotNull())
    return good.select(F.when(stub, F.col("below")).otherwise(F.coalesce(own, "below")).alias("key"), "path", F.when(stub, made).otherwise(F.col("text")).alias("profile"), stub.alias("stub"))


def _quoted(base: str) -> str:
    scheme, _, rest = base.partition(":")
    return r"\Q" + scheme + ":/" + rest.lstrip("/") + r"\E"


def bundles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, notes) of zipped CBOR arrays of [name, value] (path, content): profiles as ``SCHEMA``, notes (path, name, value) are those
    whose name starts with two underscores, such as the version. Files of another kind give nothing."""
    ensure_shipped(files.sparkSession)

    def pairs(data: bytes) -> list[tuple[str, str]]:
        try:
            found = codecs.uncbor(zlib.decompress(data, 31))
        except (zlib.error, ValueError, IndexError, KeyError, UnicodeDecodeError):
            return []
        items = found if isinstance(found, list) else []
        return [(x[0], json.dumps(x[1])) for x in items if isinstance(x, list) and len(x) == 2 and isinstance(x[0], str)]

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, k, name, value) for p, c in zip(pdf["path"], pdf["content"], strict=True) for k, (name, value) in enumerate(pairs(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "position", "name", "value"])

    found = files.select("path", "content").mapInPandas(fn, "path string, position int, name string, value string")
    note = F.startswith("name", F.lit("__"))
    key = F.coalesce(F.nullif(F.get_json_object("value", "$.identifier"), F.lit("")), "name")
    return found.where(~note).select(key.alias("key"), "path", F.col("value").alias("profile"), F.lit(False).alias("stub")), found.where(note).select("path", "name", "value")


def load(spark: SparkSession, extra: list[str], candidates: list[str], bundle_name: str = "profiles.cbor.gz") -> DataFrame:
    """All of ``extra`` (folders), then the first of ``candidates`` that has a profile; the first of equal keys wins.
    A folder's bundle goes before its files."""
    def of(root: str) -> DataFrame | None:
        conf = spark._jsc.hadoopConfiguration()
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        inside = spark._jvm.org.apache.hadoop.fs.Path(path, bundle_name)
        if fs.exists(inside):
            return bundles(spark.read.format("binaryFile").load(inside.toString()))[0]
        return tree(spark, root)

    parts = [found for root in extra if (found := of(root)) is not None]
    for root in candidates:
        found = of(root)
        if found is not None and found.limit(1).count():
            parts.append(found)
            break
    out = spark.createDataFrame([], SCHEMA + ", source int")
    for k, part in enumerate(parts):
        out = out.unionByName(part.withColumn("source", F.lit(k)))
    return catalog.first_wins(out, ["key"], ["source", "path"])


def projects(spark: SparkSession, path: str) -> DataFrame:
    """(path, project): one whole JSON file a row, as a variant, so that fields nobody knows are kept."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.try_parse_json("value").alias("project"))


def overlaid(base: Column, over: Column) -> Column:
    """Two JSON texts: objects merge by key at every depth, anything else of ``over`` takes the other's place."""

    def put(a, b):
        return a | {k: put(a[k], v) if k in a else v for k, v in b.items()} if isinstance(a, dict) and isinstance(b, dict) else b

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([u if v is None else v if u is None else json.dumps(put(json.loads(u), json.loads(v)), sort_keys=True, separators=(",", ":")) for u, v in zip(x, y, strict=True)])

    return F.pandas_udf(each, "string")(base, over)


def save(projects_: DataFrame, path: str) -> None:
    """Projects (project: a variant) as lines of JSON."""
    projects_.select(F.to_json("project").alias("value")).write.text(path)


def calibrated(model: Column, width: Column, height: Column, matrix: Column, coefficients: Column, error: Column, images: Column, fit_error: Column) -> Column:
    """A calibration as the JSON text of a profile; the error of a fit stands there only if there was one."""
    return F.to_json(F.struct(
        F.struct(width.alias("w"), height.alias("h")).alias("calib_dimension"), model.alias("distortion_model"),
        F.struct(matrix.alias("camera_matrix"), coefficients.alias("distortion_coeffs"), error.alias("RMS_error")).alias("fisheye_params"), images.alias("num_images"), fit_error.alias("distortion_model_fit_error"),
    ))
