"""EPUB packages as tables: one row per spine document, plus titles, creators and navigation.

Files come through Spark's binaryFile reader, so any file system it knows will do; each
package is opened in the task that holds it.
"""

from __future__ import annotations

import io
import posixpath
import re
import urllib.parse
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPINE = "path string, doc_index long, item_id string, name string, media_type string, content binary"
_META = "path string, seq long, kind string, level long, title string, target string"


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _package(data: bytes):
    """(zip, folder of the package file, its root element)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    name = next(e.get("full-path") for e in box.iter() if _local(e) == "rootfile")
    return z, posixpath.dirname(name), ElementTree.fromstring(z.read(name))


def _items(root, folder: str) -> dict[str, tuple[str, str, str]]:
    return {e.get("id"): (posixpath.normpath(posixpath.join(folder, urllib.parse.unquote(e.get("href") or ""))), e.get("media-type") or "", e.get("properties") or "") for e in root.iter() if _local(e) == "item"}


_DOC = ("application/xhtml+xml", "text/html")


def read_spine(data: bytes) -> list[tuple[int, str, str, str, bytes]]:
    """(index, id, name, media type, content) in reading order; all documents where the spine names none."""
    z, folder, root = _package(data)
    items = _items(root, folder)
    refs = [e.get("idref") for e in root.iter() if _local(e) == "itemref"]
    ids = [i for i in refs if i in items and items[i][1] in _DOC] or [i for i, x in items.items() if x[1] in _DOC]
    here = set(z.namelist())
    return [(k, i, items[i][0], items[i][1], z.read(items[i][0]) if items[i][0] in here else b"") for k, i in enumerate(ids)]


def read_metadata(data: bytes) -> list[tuple[int, str, int, str, str]]:
    """(seq, kind, level, title, target): titles, creators, then the navigation's entries from the NCX or nav document."""
    z, folder, root = _package(data)
    out: list[tuple[str, int, str, str]] = [(_local(e), 0, "".join(e.itertext()).strip(), "") for e in root.iter() if _local(e) in ("title", "creator")]
    items = _items(root, folder)
    ncx = next((x for x in items.values() if x[1] == "application/x-dtbncx+xml"), None)
    nav = next((x for x in items.values() if "nav" in x[2].split()), None)

    def points(e, level: int) -> None:
        for p in e:
            if _local(p) == "navPoint":
                label = next(("".join(x.itertext()).strip() for x in p if _local(x) == "navLabel"), "")
                src = next((x.get("src") or "" for x in p if _local(x) == "content"), "")
                out.append(("nav", level, label, src))
                points(p, level + 1)

    def lists(e, level: int) -> None:
        for p in e:
            name = _local(p)
            if name == "a":
                out.append(("nav", level, " ".join("".join(p.itertext()).split()), p.get("href") or ""))
            else:
                lists(p, level + (name == "ol"))

    if ncx and ncx[0] in z.namelist():
        for e in ElementTree.fromstring(z.read(ncx[0])).iter():
            if _local(e) == "navMap":
                points(e, 1)
    elif nav and nav[0] in z.namelist():
        for e in ElementTree.fromstring(z.read(nav[0])).iter():
            if _local(e) == "nav" and any(k.endswith("type") and v == "toc" for k, v in e.attrib.items()):
                lists(e, 0)
    return [(k, *x) for k, x in enumerate(out)]


def _read(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _rows(read, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    out += [(path, *r) for r in read(data)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue  # no package: no rows
            yield pd.DataFrame(out, columns=names)

    return run


def spine(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """Documents of all packages under a path. A file that is no package has no rows."""
    return _read(spark, path, pattern).mapInPandas(_rows(read_spine, [c.split()[0] for c in _SPINE.split(", ")]), _SPINE)


def metadata(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    return _read(spark, path, pattern).mapInPandas(_rows(read_metadata, [c.split()[0] for c in _META.split(", ")]), _META)


def pages(spine_rows: DataFrame) -> DataFrame:
    """Spine rows as the pages (page_id, url, html) of the probe, numbered within a book."""
    return spine_rows.select("path", F.col("doc_index").alias("page_id"), F.col("name").alias("url"), F.decode("content", "UTF-8").alias("html"))


def safe_name(filename: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", posixpath.basename(filename)) or "upload"
