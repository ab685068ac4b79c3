"""Text of EPUB files: a zip archive whose package names the documents in reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ebook_text
from .html import text_of

SECTIONS = "path string, title string, authors array<string>, section int, text string, error string"
#: Documents that lead to others only. Fixed value.
GUIDES = re.compile(r"^(nav|toc|cover)([._-]|$)")


def read_epub(content: bytes) -> tuple[str | None, list[str], list[str]]:
    """Title, authors and section texts in the order of the spine, or of the manifest if it names none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = box.find(".//{*}rootfile").attrib["full-path"]
        root, at = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        named = lambda tag: [(e.text or "").strip() for e in root.iter() if e.tag.rsplit("}", 1)[-1] == tag and (e.text or "").strip()]
        manifest = {e.attrib["id"]: (e.attrib["href"], e.attrib.get("media-type", "")) for e in root.iterfind("{*}manifest/{*}item")}
        documents = {k: unquote(h) for k, (h, kind) in manifest.items() if "html" in kind}
        spine = [documents[e.attrib["idref"]] for e in root.iterfind("{*}spine/{*}itemref") if e.attrib.get("idref") in documents]
        spine = [h for h in spine if not GUIDES.match(posixpath.splitext(posixpath.basename(h))[0].lower())]
        files = set(z.namelist())
        wanted = [posixpath.normpath(posixpath.join(at, h)) for h in spine or documents.values()]
        texts = [text_of(z.read(h).decode("utf-8", "replace")) for h in wanted if h in files]
    return next(iter(named("title")), None), named("creator"), [t for t in texts if t]


def epub_sections(files: DataFrame) -> DataFrame:
    """``(path, title, authors, section, text, error)`` of files(path, content); a file that can't be
    read is one row with its error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    title, authors, texts = read_epub(content or b"")
                    rows += [(path, title, authors, i, t, None) for i, t in enumerate(texts)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError) as e:
                    rows.append((path, None, [], None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SECTIONS.split(", ")])

    return files.select("path", "content").mapInArrow(run, SECTIONS)


def epub_texts(files: DataFrame) -> DataFrame:
    """``(path, text)``: each book as one text with its title and authors in front."""
    s = epub_sections(files).where("error is null")
    held = s.groupBy("path").agg(F.first("title").alias("title"), F.first("authors").alias("authors"), F.array_sort(F.collect_list(F.struct("section", "text"))).alias("s"))
    return held.select("path", ebook_text(F.col("title"), F.col("authors"), F.transform("s", lambda x: x["text"])).alias("text"))
