import io
import zipfile

import pytest

from scriptoria.sources.files import read_blocks, rtf_text
from scriptoria.sources.packages import exported, read_package, write_package


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><!-- <p>no</p> --><h1>Wykład &amp; reszta</h1><p>Pierwszy <b>aka</b>pit<br>dalej &#8222;x&#x2019; &amp;lt; &zzz; &#0;</p>loose<ul><li>jeden</li></ul></body></html>"
OFFICE, WORD = "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
FILES = {
    "a.html": PAGE.encode(),
    "b.md": "# Tytuł\n\nakapit z **mocnym** [łączem](x)\ndalej\n- punkt\n".encode(),
    "c.txt": "WSTĘP DO PRAWA\n\npierwszy\n\n1. raz\n2. dwa\n\ndrugi ąę".encode("cp1250"),
    "d.rtf": rb"{\rtf1\ansi\ansicpg1250{\fonttbl{\f0 Arial;}}Zdanie \'b9 i \u322?.\par Drugie{\*\hidden x}\line koniec \emdash\ldblquote c\rdblquote}",
    "e.odt": packed({"content.xml": f'<o xmlns:text="{OFFICE}"><text:h text:outline-level="2">Tytuł</text:h><text:p>Akapit</text:p></o>'}),
    "f.docx": packed({"word/document.xml": f'<w:d xmlns:w="{WORD}"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Tytuł</w:t></w:r></w:p><w:p><w:r><w:t>Aka</w:t></w:r><w:r><w:t>pit</w:t></w:r></w:p></w:d>'}),
    "g.epub": packed({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p xmlns="u"><item id="x" href="2.xhtml"/><item id="y" href="1.xhtml"/><itemref idref="y"/><itemref idref="x"/></p>', "o/1.xhtml": "<p>raz</p>", "o/2.xhtml": "<p>dwa</p>"}),
    "h.docx": b"broken", "i.doc": b"old", "j.txt": b"  \n",
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_formats(spark, folder):
    rows = read_blocks(spark, folder).collect()
    by = lambda name: [(r.kind, r.level, r.text, r.page) for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.ord)]
    assert by("a.html") == [("heading", 1, "Wykład & reszta", None), ("para", None, "Pierwszy akapit dalej „x’ &lt; &zzz; &#0;", None), ("para", None, "jeden", None)]
    assert by("b.md") == [("heading", 1, "Tytuł", None), ("para", None, "akapit z mocnym łączem dalej", None), ("para", None, "- punkt", None)]
    assert by("c.txt") == [("heading", 2, "WSTĘP DO PRAWA", None), ("para", None, "pierwszy", None), ("para", None, "1. raz", None), ("para", None, "2. dwa", None), ("para", None, "drugi ąę", None)]
    assert [x[2] for x in by("d.rtf")] == ["Zdanie ą i ł.", "Drugie", 'koniec —"c"']
    assert by("e.odt") == [("heading", 2, "Tytuł", None), ("para", None, "Akapit", None)]
    assert by("f.docx") == [("heading", 1, "Tytuł", None), ("para", None, "Akapit", None)]
    assert [(x[2], x[3]) for x in by("g.epub")] == [("raz", 1), ("dwa", 2)]
    assert {r.path[-6:]: r.error is not None for r in rows if r.status == "error"} == {"h.docx": True, "/i.doc": True, "/j.txt": True}


def test_rtf_stand_ins():
    assert rtf_text(rb"{\rtf1\uc2 a\u322 xxb\uc0\u380 c\{\}}") == "ałbżc{}"


def test_package_round_trip(spark, tmp_path):
    tables = {
        "source_chunk": spark.createDataFrame([("c1", "ą"), ("c2", None)], "chunk_id string, text string"),
        "citation": spark.createDataFrame([("x", "c1")], "id string, chunk_id string"),
        "tombstone": spark.createDataFrame([("t", "1")], "table_name string, id string"),
        "setting": spark.createDataFrame([("ai", "1"), ("daily", "2")], "key string, value string"),
    }
    write_package(exported(tables, "backup"), f"{tmp_path}/p", "backup")
    back = read_package(spark, f"{tmp_path}/p")
    assert {n: sorted(df.collect()) for n, df in back.items()} == {n: sorted(df.collect()) for n, df in tables.items()}
    assert [r.chunk_id for r in exported(tables, "content")["source_chunk"].collect()] == ["c1"]
    assert "tombstone" not in exported(tables, "progress") and [r.key for r in exported(tables, "sync")["setting"].collect()] == ["daily"]
