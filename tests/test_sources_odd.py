"""Odd book files and sound files: each gives a row, none ends the scan of the others."""

import struct
import zipfile

from pyspark.sql import functions as F
from test_sources import CONTAINER, PACKAGE

from storyloom.sources import wav
from storyloom.sources.epub import parse_book, read_epubs


def book(path, package, files):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("o/p.opf", package)
        for name, body in files.items():
            z.writestr(name, body)


def test_an_oversized_book_gives_an_error_row(spark, tmp_path):
    book(tmp_path / "large.epub", PACKAGE, {"o/a.xhtml": "<p>" + "long text " * 50 + "</p>"})
    (row,) = read_epubs(spark, str(tmp_path), max_bytes=100).collect()
    assert row.path.endswith("large.epub") and row.error.startswith("larger than 100 bytes") and row.raw_text is None


def test_a_book_that_lacks_parts_keeps_the_others(tmp_path):
    odd = PACKAGE.replace('<item id="b" ', "<item ")
    book(tmp_path / "odd.epub", odd, {"o/a.xhtml": "<p>First.</p>"})
    rows = parse_book("odd.epub", (tmp_path / "odd.epub").read_bytes())
    assert [(r[4], r[6], r[8], r[9]) for r in rows] == [(None, 1, "First.", None)]
    bare = PACKAGE[: PACKAGE.index("<metadata>")] + PACKAGE[PACKAGE.index("</metadata>") + len("</metadata>") :]
    book(tmp_path / "bare.epub", bare, {"o/a.xhtml": "<p>First.</p>"})
    assert [(r[1], r[8], r[9]) for r in parse_book("bare.epub", (tmp_path / "bare.epub").read_bytes())] == [("bare", "First.", None)]


def chunked(pcm, rate, *before):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + b"".join(before) + fmt + b"LIST" + struct.pack("<I", 5) + b"datax\0" + b"data" + struct.pack("<I", len(pcm)) + pcm
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_headers_with_further_chunks(spark):
    pcm = bytes(2 * 441)
    sounds = [(0, wav.wrap_pcm(pcm)), (1, chunked(pcm, 44_100)), (2, chunked(pcm, 44_100, b"JUNK" + struct.pack("<I", 4) + b"data")), (3, b"RIFF"), (4, b""), (5, None)]
    df = spark.createDataFrame(sounds, "i int, audio binary")
    got = df.select("i", wav.header(F.col("audio")).alias("h"), wav.duration_ms(F.col("audio")).alias("ms")).orderBy("i").collect()
    assert [None if r.h is None else tuple(r.h) for r in got] == [(1, 2, 22_050, 441), (1, 2, 44_100, 441), (1, 2, 44_100, 441), None, None, None]
    assert [r.ms for r in got] == [20, 10, 10, None, None, None]
