"""EPUB scan: one row for each chapter of each book file, read with binaryFile and parsed where the file is."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.html import extract

#: Bytes of a book file that are read at most.
MAX_BYTES = 50 << 20
_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}
SCHEMA = "path string, title string, author string, language string, cover binary, cover_type string, position int, chapter_title string, raw_text string, error string"


def _first(meta: ElementTree.Element, tag: str) -> str | None:
    found = meta.find(f".//d:{tag}", _NS)
    return (found.text or "").strip() or None if found is not None else None


def _cover(items: list[dict[str, str]], meta: ElementTree.Element) -> dict[str, str] | None:
    """By the id that the metadata names, by an image with a cover id, by property, by a name with `cover` in it."""
    named = next((m.get("content") for m in meta.iter() if m.tag.endswith("meta") and m.get("name") == "cover"), None)
    image = lambda i: i.get("media-type", "").startswith("image/")
    for fits in (
        lambda i: named and i.get("id") == named,
        lambda i: image(i) and "cover" in i.get("id", "").lower(),
        lambda i: "cover-image" in i.get("properties", "").split(),
        lambda i: image(i) and "cover" in i.get("href", "").lower(),
    ):
        if (hit := next(filter(fits, items), None)) is not None:
            return hit
    return None


def _rejected(path: str, why: str) -> list[tuple]:
    return [(path, *[None] * 8, why)]


def parse_book(path: str, content: bytes) -> list[tuple]:
    """Rows of SCHEMA. Documents without text are skipped and take no position; a broken book gives one error row.

    A manifest item without an id is no chapter, a cover or chapter that the archive lacks is left out.
    """
    try:
        return _chapters(path, content)
    except Exception as why:  # whatever is wrong with one file, the others are read
        return _rejected(path, f"not an EPUB: {type(why).__name__}: {why}")


def _chapters(path: str, content: bytes) -> list[tuple]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
        package = ElementTree.fromstring(book.read(root))
    except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as why:
        return _rejected(path, f"not an EPUB: {why}")
    found = package.find("o:metadata", _NS)
    meta = ElementTree.Element("metadata") if found is None else found
    items = [dict(i.attrib) for i in package.iterfind("o:manifest/o:item", _NS)]
    by_id = {i["id"]: i for i in items if "id" in i}
    held = set(book.namelist())
    at = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(root), href))
    cover = _cover([i for i in items if at(i.get("href", "")) in held], meta)
    stem = posixpath.splitext(posixpath.basename(path))[0]
    head = (path, _first(meta, "title") or stem, _first(meta, "creator"), _first(meta, "language"), book.read(at(cover["href"])) if cover else None, cover.get("media-type") if cover else None)
    rows: list[tuple] = []
    for ref in package.iterfind("o:spine/o:itemref", _NS):
        item = by_id.get(ref.get("idref"))
        if item is None or at(item.get("href", "")) not in held or "html" not in item.get("media-type", "") or "nav" in item.get("properties", "").split():
            continue
        text, title = extract(book.read(at(item["href"])).decode("utf-8", "replace"))
        if text.strip():
            rows.append((*head, len(rows) + 1, title, text, None))
    return rows


def read_epubs(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All books under path; a file larger than max_bytes is not read and gives an error row."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path), max_bytes)


def parsed(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of SCHEMA from files (path, length, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = pd.DataFrame(parse_book(name, bytes(content)), columns=names)
                yield rows.astype({"position": "Int32"})

    read = files.where(f"length <= {max_bytes}").select("path", "content").mapInPandas(parse, SCHEMA)
    names = [tuple(f.split()) for f in SCHEMA.split(", ")]
    told = {"path": F.col("path"), "error": F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes: "), F.col("length"))}
    large = files.where(f"length > {max_bytes}").select(*[told.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names])
    return read.unionByName(large)
