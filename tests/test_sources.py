"""EPUB scan and the chapter stream."""

import zipfile

from storyloom.sources.epub import parse_book, read_epubs
from storyloom.streaming.ingest import chapter_stream, segment_stream

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:creator>Ann</dc:creator><dc:language>fr</dc:language><meta name="cover" content="img"/></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/>
<item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="img" href="x.png" media-type="image/png"/></manifest>
<spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/><itemref idref="c"/></spine></package>"""


def make(path):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in {
            "META-INF/container.xml": CONTAINER, "o/p.opf": PACKAGE, "o/a.xhtml": "<h1>One</h1><p>First text.</p>", "o/b.xhtml": "<div> </div>", "o/c.xhtml": "<p>Last.</p>", "o/n.xhtml": "<p>toc</p>", "o/x.png": "png",
        }.items():
            z.writestr(name, body)


def test_epub_scan(spark, tmp_path):
    make(tmp_path / "My Book.EPUB")
    (tmp_path / "bad.epub").write_text("no zip")
    rows = read_epubs(spark, str(tmp_path)).orderBy("position").collect()
    good = [r for r in rows if r.error is None]
    assert [(r.position, r.chapter_title, r.raw_text) for r in good] == [(1, "One", "One\nFirst text."), (2, None, "Last.")]
    assert (good[0].title.replace("%20", " "), good[0].author, good[0].language, bytes(good[0].cover)) == ("My Book", "Ann", "fr", b"png")
    assert len([r for r in rows if r.error]) == 1
    assert parse_book("x.epub", b"")[0][-1].startswith("not an EPUB")


def test_stream_segments_each_chapter_once(spark, tmp_path):
    schema = "chapter_id long, language string, raw_text string"
    spark.createDataFrame([(1, "fr", 'Tôt. "Oui." Fin.')], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: segment_stream(chapter_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "en", '"Go."')], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("chapter_id", "position").collect()
    assert [(r.chapter_id, r.text) for r in got] == [(1, "Tôt."), (1, "Oui."), (1, "Fin."), (2, "Go.")]
