"""Documents as pages and blocks of text (SRC5-7, TXT21): Word files with the standard library; PDF and images where their readers are installed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.collections import decode_document, kind

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_blocks(data: bytes) -> list[str]:
    """SRC6: paragraphs in order, then tables row by row, cells joined by a bar. Pictures are left to the page reader."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join((x.text or "") if x.tag == f"{_W}t" else "\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else "" for x in e.iter())
    paragraphs = [words(p) for p in body.findall(f"{_W}p")]
    rows = [" | ".join("\n".join(words(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return [x for x in (*paragraphs, *rows) if x.strip()]


def pdf_pages(data: bytes) -> list[str]:
    """SRC5: text layer per page, in order. Needs pypdfium2."""
    import pypdfium2

    with pypdfium2.PdfDocument(data) as pdf:
        return [page.get_textpage().get_text_range() for page in pdf]


def grey_frames(data: bytes) -> list[np.ndarray]:
    """SRC7: the frames of a binary greymap (several may follow each other), with NumPy alone."""
    out, at = [], 0
    while m := re.compile(rb"\s*P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s").match(data, at):
        width, height, most = map(int, m.groups())
        kind = np.dtype("u1" if most < 256 else ">u2")
        pixels = np.frombuffer(data, kind, width * height, m.end()).reshape(height, width)
        out.append(pixels if most == 255 else (pixels.astype(float) * 255 / most).round().astype(np.uint8))
        at = m.end() + width * height * kind.itemsize
    return out


def image_frames(data: bytes) -> list[np.ndarray]:
    """SRC7: every frame of an image as a grey array. Formats other than greymaps need Pillow."""
    if data[:2] == b"P5":
        return grey_frames(data)
    from PIL import Image, ImageSequence

    return [np.asarray(f.convert("L")) for f in ImageSequence.Iterator(Image.open(io.BytesIO(data)))]


_READERS = {"docx": docx_blocks, "pdf": pdf_pages, "text": lambda b: [decode_document(b)]}


def blocks(files: DataFrame) -> DataFrame:
    """SRC1/SRC2: path, ix, text and error of each block of the files that hold text; a file that cannot be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, how, data in zip(pdf["path"], pdf["how"], pdf["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(_READERS[how](bytes(data)))]
                except Exception as e:  # noqa: BLE001  reported as a row
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ix", "text", "error"])

    read = files.withColumn("how", kind("path")).filter(F.col("how").isin(*_READERS)).select("path", "how", "content")
    return read.mapInPandas(run, "path string, ix int, text string, error string")
