"""Pages of PDF files made here: plain and packed objects, character maps, kerning, filters, order and bounds."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.sources import files
from quillon.sources.pdf import File, _lzw, pdf_pages, values


def stream(data, head=b"", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<< %s%s /Length %d >>\nstream\n%s\nendstream" % (b"/Filter /FlateDecode " if packed else b"", head, len(body), body)


def pdf(pages, fonts=b"<< /F1 3 0 R >>", more=(), packed=True):
    """A file with a stream of operators for each page, all pages under one inner node."""
    kids = b" ".join(b"%d 0 R" % (20 + 2 * i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R] /Count %d >>" % len(pages), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Pages /Parent 2 0 R /Resources << /Font %s >> /Kids [%s] >>" % (fonts, kids)}
    for i, page in enumerate(pages):
        objects[20 + 2 * i] = b"<< /Type /Page /Parent 4 0 R /Contents %d 0 R >>" % (21 + 2 * i)
        objects[21 + 2 * i] = stream(page, packed=packed)
    objects |= dict(more)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_lines_and_pages():
    first = rb"BT /F1 12 Tf 72 700 Td (Best Practice: Ask \(first\)) Tj 0 -14 Td (Second \101 line) Tj T* (Third) Tj ET BT 1 0 0 1 72 90 Tm [(Ker) -20 (ned) -400 (words)] TJ ET"
    assert pdf_pages(pdf([first, b"", b"BT (Last) Tj ET"])) == ["Best Practice: Ask (first)\nSecond A line\nThird\nKerned words", "", "Last"]
    assert pdf_pages(pdf([b"BT (%d) Tj ET" % i for i in range(9)], packed=False), 4) == ["0", "1", "2", "3"]


def test_character_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0066006C> <03B1>] endbfrange"
    font = {3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", 7: stream(cmap)}
    assert pdf_pages(pdf([b"BT /F1 9 Tf <0010001100120001> Tj <00200021> Tj ET"], more=font.items())) == ["ABCéflα"]
    assert pdf_pages(pdf([b"BT /F1 9 Tf (caf\xe9 \x93x\x94) Tj ET"])) == ["café “x”"]


def test_packed_objects_and_forms():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [5 0 R] >>"), (5, b"<< /Type /Page /Contents [6 0 R 7 0 R] /Resources << /XObject << /X 8 0 R >> >> >>")]
    heads, body = b"", b""
    for n, o in inner:
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    objects = [(9, stream(heads + body, b"/Type /ObjStm /N 3 /First %d " % len(heads))), (6, stream(b"BT (a) Tj ET")), (7, stream(b"/X Do")), (8, stream(b"BT (in a form) Tj ET", b"/Type /XObject /Subtype /Form "))]
    assert pdf_pages(b"%PDF-1.5\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in objects)) == ["a\nin a form"]


def test_filters_and_values():
    data = b"BT (by another filter) Tj ET"
    coded = base64.a85encode(data) + b"~>"
    more = {21: b"<< /Filter [/ASCII85Decode] /Length 10 0 R >>\nstream\n" + coded + b"\nendstream", 10: b"%d" % len(coded)}
    assert pdf_pages(pdf([b""], more=more.items())) == ["by another filter"]
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert [v for v, _ in values(b"<< /A [1 -2.5 (x\\ny) <4142>] /B 3 0 R >> true")] == [{"A": [1, -2.5, b"x\ny", b"AB"], "B": 3}, "true"]


@pytest.mark.parametrize("data", [b"", b"plain text", pdf([b""]).replace(b"trailer <<", b"trailer << /Encrypt 5 0 R")])
def test_refused(data):
    with pytest.raises(ValueError):
        File(data)


def test_files_with_errors(spark, tmp_path):
    (tmp_path / "Book.PDF").write_bytes(pdf([b"BT (Rule 1: Always ask before you sell) Tj ET", b"BT (Second) Tj ET"]))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "c.Md").write_text("# Head\n\ntext")
    (tmp_path / "other.xyz").write_text("no")
    found = files.books(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in found.drop("content").collect()) == ["Book.PDF", "bad.pdf", "c.Md"]
    rows = files.extracted(found).join(found.select("file_hash", "file_name"), "file_hash").collect()
    assert [(r["page_no"], r["text"]) for r in sorted(rows, key=lambda r: r["page_no"]) if r["file_name"] == "Book.PDF"] == [(1, "Rule 1: Always ask before you sell"), (2, "Second")]
    assert [r["error"] for r in rows if r["file_name"] == "bad.pdf"] == ["ValueError: not a PDF file"]
    assert files.extracted(found.where(F.col("file_name") == "none")).count() == 0
