"""Files as tables: listing, plain texts and DOCX paragraphs with pseudo-pages; further formats can be registered."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import word_count
from quillon.operators.lineage import written
from quillon.sources.pdf import pdf_pages

FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "txt": "text", "md": "text"}
PAGE_CHARACTERS = 2_000
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_format(path: Column) -> Column:
    """The format of a path's last extension; others raise."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.raise_error(F.concat(F.lit("unsupported format: "), ext))
    for name, kind in FORMATS.items():
        out = F.when(ext == name, F.lit(kind)).otherwise(out)
    return out


def books(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supported file of a folder, by name: path, name, format, bytes, MB and SHA-256; suffixes in any case.

    Of files of one name in different folders the first path counts; it is chosen from the listing, before any content is read.
    """
    either = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    pattern = "*.{" + ",".join(either(ext) for ext in sorted(FORMATS)) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    paths = [r["path"] for r in reader.load(folder).groupBy(name.alias("name")).agg(F.min("path").alias("path")).toLocalIterator()]
    raw = reader.load(paths) if paths else reader.load(folder)
    return raw.select(F.col("path").alias("file_path"), name.alias("file_name"), file_format(F.col("path")).alias("format"), F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.sha2("content", 256).alias("file_hash"), "content")


def pages(paragraphs: list[str], most: int = PAGE_CHARACTERS) -> list[str]:
    """Paragraphs filled into pages; one closes when it has ``most`` characters."""
    out, held, size = [], [], 0
    for p in paragraphs:
        if not p.strip():
            continue
        held.append(p)
        size += len(p)
        if size >= most:
            out.append("\n".join(held))
            held, size = [], 0
    return [*out, "\n".join(held)] if held else out


def docx_pages(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return pages(["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p")])


def text_pages(content: bytes) -> list[str]:
    return pages(re.split(r"\n\s*\n", content.decode("utf-8", "replace")))


READERS: dict[str, Callable[[bytes], list[str]]] = {"pdf": pdf_pages, "docx": docx_pages, "text": text_pages}
MODES = ("direct", "ocr", "hybrid")
#: Quality of directly read text below which a scan is tried, and below which a text without one is repaired.
POOR, BROKEN = 0.3, 0.1


def register(kind: str, reader: Callable[[bytes], list[str]], *extensions: str) -> None:
    """Add a reader: bytes of a file in, its pages out."""
    READERS[kind] = reader
    FORMATS.update(dict.fromkeys(extensions, kind))


def extracted(files: DataFrame) -> DataFrame:
    """``(file_hash, page_no, text, error)`` of files; one error row instead of pages where a reader fails."""
    readers = dict(READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, kind, content in zip(batch["file_hash"], batch["format"], batch["content"], strict=True):
                try:
                    rows += [(digest, i, t, None) for i, t in enumerate(readers[kind](content), 1)]
                except Exception as problem:  # noqa: BLE001  one bad file must not end the scan
                    rows.append((digest, 0, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["file_hash", "page_no", "text", "error"])

    return files.select("file_hash", "format", "content").mapInPandas(run, "file_hash string, page_no int, text string, error string")


def recognised(files: DataFrame, scanned: Callable[[bytes], list[str]]) -> DataFrame:
    """``(file_hash, page_no, text, error)`` by a reader of scans; blank pages are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, content in zip(batch["file_hash"], batch["content"], strict=True):
                try:
                    rows += [(digest, i, t, None) for i, t in enumerate(scanned(content), 1) if t.strip()]
                except Exception as problem:  # noqa: BLE001  one bad file must not end the scan
                    rows.append((digest, 0, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["file_hash", "page_no", "text", "error"])

    return files.select("file_hash", "content").mapInPandas(run, "file_hash string, page_no int, text string, error string")


def read(files: DataFrame, mode: str = "direct", scanned: Callable[[bytes], list[str]] | None = None, fallback: bool = True) -> DataFrame:
    """``(file_hash, page_no, text, error, method)`` by mode; only PDF files are ever scanned.

    ``ocr`` scans them all; ``hybrid``, and ``direct`` with ``fallback``, scan those whose direct text is poor. Without a reader of
    scans, the lines of broken text are repaired instead.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "ocr" and scanned is None:
        raise ValueError("mode ocr needs a reader of scans")
    drawn, others = files.where("format = 'pdf'"), files.where("format <> 'pdf'")
    plain = extracted(others).withColumn("method", F.lit("direct"))
    if mode == "ocr":
        return plain.unionByName(recognised(drawn, scanned).withColumn("method", F.lit("ocr")))
    if scanned is not None and fallback:
        return plain.unionByName(hybrid(drawn, scanned))
    pages_ = written(extracted(drawn).withColumn("method", F.lit("direct")), "direct")
    sizes = pages_.where("error IS NULL").groupBy("file_hash").agg(F.sum(word_count(F.col("text"))).alias("w"), F.count(F.lit(1)).alias("n"))
    broken = sizes.select("file_hash", (page_quality(F.col("w").cast("double"), F.col("n").cast("double")) < BROKEN).alias("_broken"))
    joined = pages_.join(broken, "file_hash", "left")
    return plain.unionByName(joined.withColumn("text", F.when(F.col("_broken"), repaired(F.col("text"))).otherwise(F.col("text"))).drop("_broken"))


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Hexadecimal digest of bytes or text by a named algorithm."""
    made = {"md5": F.md5, "sha1": F.sha1, "crc32": lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")} | {f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}
    if algorithm not in made:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return made[algorithm](content)


def chunk_list_digest(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """``(key, digest)`` of each document's chunks in order, by the digests of their texts: no task holds a document's text again."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(text, 256).alias("h"))))
    return chunks.groupBy(key).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), ""), 256).alias("digest"))


def hybrid(files: DataFrame, scanned: Callable[[bytes], list[str]], least: float = POOR) -> DataFrame:
    """``(file_hash, page_no, text, error, method)``: pages read directly, or recognised by ``scanned`` where the text is poor or unreadable.

    A file is read twice only if its first reading is of quality below ``least``.
    """
    direct = written(extracted(files), "direct")
    sizes = direct.groupBy("file_hash").agg(F.sum(F.when(F.col("error").isNull(), word_count(F.col("text"))).otherwise(0)).alias("w"), F.count_if(F.col("error").isNull()).alias("n"))
    poor = sizes.where(page_quality(F.col("w").cast("double"), F.col("n").cast("double")) < least).select("file_hash")

    again = recognised(files.join(poor, "file_hash", "left_semi"), scanned)
    kept = direct.join(poor, "file_hash", "left_anti").withColumn("method", F.lit("direct"))
    return kept.unionByName(again.withColumn("method", F.lit("hybrid")))


def page_quality(words_: Column, n_pages: Column) -> Column:
    """Quality of directly extracted text by words a page."""
    rate = F.try_divide(words_, n_pages)
    return F.when(n_pages <= 0, 0.0).when(rate > 150, 1.0).when(rate > 50, 0.5).when(rate > 10, 0.2).otherwise(0.05)


def scan_quality(words_: Column, n_pages: Column) -> Column:
    """Quality of recognised text by words a page."""
    rate = F.try_divide(words_, n_pages)
    return F.when((n_pages <= 0) | (words_ <= 0), 0.0).when(rate > 200, 0.9).when(rate > 80, 0.7).when(rate > 20, 0.4).otherwise(0.15)


def repaired(text: Column) -> Column:
    """Words joined over hyphens at line ends; single line breaks become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""), r"(?<!\n)\n(?!\n)", " ")
