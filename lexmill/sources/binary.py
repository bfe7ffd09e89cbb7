"""Raw document files: format by content, text by format, one row a file."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import decode_entities, markup_removed

# Names, marks and limits of the accepted files.
SKIPPED_SUFFIXES = (".dmg", ".zip", ".exe", ".pkg")
SKIPPED_NAMES = (".DS_Store", "Thumbs.db")
PALM_TYPES = (b"BOOKMOBI", b"TEXtREAd")
SIDE_PAGES = r"(?i)(nav|toc|cover|copyright|titlepage)\."
BOILERPLATE = r"(z-?library|1lib|z-lib|书友|扫码|关注公众号|版权|仅供学习)"
BOILERPLATE_CHARS, SCANNED_DENSITY, LENGTH_SLACK = 80, 120, 64
ENCODINGS = ("utf-8", "gb18030", "utf-16")
FLAGS = range(0x40)
#: Bytes of files that a worker unpacks at once, about.
PIECE_BYTES = 4 << 20


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, content) of the files of a folder tree, without archives and system files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), "content")
    return named.filter(~F.col("suffix").isin(*SKIPPED_SUFFIXES) & ~F.col("name").isin(*SKIPPED_NAMES))


def palm_database(content: Column) -> Column:
    """Whether the header names a Palm book and a plausible number of records."""
    records = F.conv(F.hex(F.substring(content, 77, 2)), 16, 10).cast("int")
    return (F.length(content) >= 78) & F.substring(content, 61, 8).isin(*(F.lit(x) for x in PALM_TYPES)) & (records > 0) & (records < 65535)


def sniffed(content: Column, suffix: Column) -> Column:
    """Format by the first bytes; the suffix only tells an e-book from another archive."""
    head = lambda n: F.substring(content, 1, n)
    zipped = head(4) == F.lit(b"PK\x03\x04")
    return (
        F.when(zipped & (F.lower(suffix) == ".epub"), "epub").when(zipped, "zip").when(head(4) == F.lit(b"%PDF"), "pdf")
        .when((head(3) == F.lit(b"CR!")) | (head(8) == F.lit(b"BOOKMOBI")) | palm_database(content), "mobi").otherwise("txt")
    )


def density(chars: Column, pages: Column) -> Column:
    return F.when(pages == 0, chars.cast("double")).otherwise(chars / pages)


def text_file(content: bytes) -> tuple[str, int, list[str]]:
    """First encoding that fits; else UTF-8 with what can't be read left out."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding), 0, []
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore"), 0, ["encoding guessed"]


def epub_file(content: bytes) -> tuple[str, int, list[str], str]:
    """Pages of the reading order as raw html, each closed by a form feed, and the book's title; the html is turned into
    text by Spark."""
    book = zipfile.ZipFile(io.BytesIO(content))
    local = lambda e: e.tag.rpartition("}")[2]
    package = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
    base = package.rpartition("/")[0]
    parts = list(ElementTree.fromstring(book.read(package)).iter())
    items = {e.get("id"): e.get("href") for e in parts if local(e) == "item" and "html" in (e.get("media-type") or "")}
    order = [items[i] for e in parts if local(e) == "itemref" and (i := e.get("idref")) in items]
    notes = [] if order else ["reading order is empty"]
    pages = [h for h in order or items.values() if not re.search(SIDE_PAGES, h)]
    read = lambda h: book.read(f"{base}/{h}".lstrip("/")).decode("utf-8", "ignore")
    title = next(((e.text or "").strip() for e in parts if local(e) == "title"), "")
    return "\f".join(read(h) for h in pages), len(order or items), notes, title


def unpack_palm(data: bytes) -> bytes:
    """PalmDOC: literals, runs of 1-8 raw bytes, two-byte back references, and a space with a character."""
    out, stream = bytearray(), iter(data)
    for code in stream:
        if 1 <= code <= 8:
            out.extend(b for _, b in zip(range(code), stream))
        elif code < 0x80:
            out.append(code)
        elif code >= 0xC0:
            out += bytes((32, code ^ 0x80))
        elif (low := next(stream, None)) is not None:
            back, size = (code << 8 | low) >> 3 & 0x7FF, (low & 7) + 3
            if 0 < back <= len(out):
                source = out[-back:]
                out += (source * (size // back + 1))[:size]
    return bytes(out)


def trailing_bytes(record: bytes, flags: int) -> int:
    """Bytes after the text of a record: one backward varint a flag bit, then the multibyte overlap."""
    end = len(record)
    for _ in range(bin(flags >> 1).count("1")):
        tail = record[max(0, end - 4) : end]
        value = 0
        for place, byte in enumerate(reversed(tail)):
            value |= (byte & 0x7F) << 7 * place
            if byte & 0x80:
                break
        end -= value
        if end <= 0:
            return len(record)
    return min(len(record), len(record) - end + ((record[end - 1] & 3) + 1 if flags & 1 and end else 0))


def mobi_file(content: bytes) -> tuple[str, int, list[str]]:
    """Html of a Palm book. Of all trailer flags that one is used which comes closest to the length the header gives."""
    count = struct.unpack_from(">H", content, 76)[0]
    starts = [struct.unpack_from(">I", content, 78 + 8 * i)[0] for i in range(count)] + [len(content)]
    head = content[starts[0] : starts[1]]
    if len(head) < 24 or head[16:20] != b"MOBI":
        raise ValueError("no book header")
    packing, _, length, texts, _, locked = struct.unpack_from(">HHIHHH", head)
    if locked or packing not in (1, 2):
        raise ValueError("locked" if locked else f"packing {packing} is unknown")
    size, codepage = struct.unpack_from(">I", head, 20)[0], struct.unpack_from(">I", head, 28)[0]
    declared = struct.unpack_from(">H", head, 0x102)[0] if size >= 0xE4 and len(head) >= 0x104 else 0
    records = [content[a:b] for a, b in zip(starts[1 : texts + 1], starts[2 : texts + 2], strict=True)]
    unpack: Callable[[bytes], bytes] = unpack_palm if packing == 2 else bytes
    best: tuple[int, int, bytes] | None = None
    for flags in sorted(FLAGS, key=lambda f: f != declared):
        text = unpack(b"".join(r[: len(r) - trailing_bytes(r, flags)] if flags and len(r) >= 8 else r for r in records))
        off = abs(len(text) - length) if length else 0
        if best is None or off < best[0]:
            best = off, flags, text
        if not off:
            break
    off, flags, text = best
    notes = ([f"trailer flags 0x{declared:02X} read as 0x{flags:02X}"] if flags != declared else []) + ([f"length differs by {off}"] if off > LENGTH_SLACK else [])
    return text[: length or None].decode("utf-8" if codepage == 65001 else "cp1252", "ignore"), texts, notes


def pdf_file(content: bytes) -> tuple[str, int, list[str]]:
    """Text of each page, by pypdf where it is installed."""
    from pypdf import PdfReader

    pages, notes = [], []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception as error:  # noqa: BLE001 - one bad page leaves the others readable
            notes.append(f"page: {error}")
            pages.append("")
    return "\n\n".join(pages), len(pages), notes


READERS = {"epub": epub_file, "mobi": mobi_file, "pdf": pdf_file, "txt": text_file, "zip": text_file}


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of a binary column take about `most` bytes together, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def extracted(files: DataFrame) -> DataFrame:
    """(path, name, suffix, format, digest, title, pages, text, notes, error) of each file.

    Only unpacking runs in Python, file by file; markup is turned into text by expressions. A file that can't be read
    has its reason in `error` and no text.
    """
    known = files.select("*", sniffed(F.col("content"), F.col("suffix")).alias("format"), F.sha2("content", 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content"):
            rows = []
            content, kinds = batch.column("content"), batch.column("format").to_pylist()
            for raw_bytes, kind in zip(content, kinds, strict=True):
                try:
                    raw, pages, notes, *title = READERS[kind](bytes(raw_bytes.as_py()))
                    rows.append((raw, pages, notes, title[0] if title else "", None))
                except Exception as error:  # noqa: BLE001 - a broken file is a row with a reason
                    rows.append((None, 0, [], "", f"{type(error).__name__}: {error}"))
            kept = [batch.column(c) for c in ("path", "name", "suffix", "format", "digest")]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["path", "name", "suffix", "format", "digest", "raw", "pages", "notes", "title", "error"])

    schema = "path string, name string, suffix string, format string, digest string, raw string, pages int, notes array<string>, title string, error string"
    return finished(known.mapInArrow(run, schema)).select("path", "name", "suffix", "format", "digest", "title", "pages", "text", "notes", "error")


def finished(raw: DataFrame) -> DataFrame:
    """Read files with their `raw` content turned into `text`, and a note on pages that are thin."""
    # columns of their own: markup is removed once, and from marked-up formats only
    broken = F.regexp_replace("raw", r"(?i)<mbp:pagebreak[^>]*>", "\n\n")
    bare = raw.withColumn("__bare", markup_removed(F.when(F.col("format") == "epub", F.col("raw")).when(F.col("format") == "mobi", broken)))
    bare = bare.withColumn("__bare", decode_entities(F.col("__bare")))
    pages = F.transform(F.split("__bare", "\f"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    kept = F.filter(pages, lambda p: (p != "") & ~((F.length(p) < BOILERPLATE_CHARS) & p.rlike(BOILERPLATE)))
    text = F.when(F.col("format") == "epub", F.array_join(kept, "\n\n")).when(F.col("format") == "mobi", F.col("__bare")).otherwise(F.col("raw"))
    done = bare.withColumn("text", text).drop("__bare")
    thin = (F.col("format") == "pdf") & (F.col("pages") > 0) & (density(F.length("text"), F.col("pages")) < SCANNED_DENSITY)
    return done.withColumn("notes", F.when(thin, F.array_append("notes", F.lit("text is thin, perhaps a scan"))).otherwise(F.col("notes")))


def extraction_report(files: DataFrame) -> DataFrame:
    """(name, format, chars, pages, density, note) of extracted() files; a file that failed has its reason as note."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    note = F.coalesce(F.concat(F.lit("failed: "), "error"), F.array_join("notes", "; "))
    return files.select("name", "format", chars.alias("chars"), "pages", density(chars, F.col("pages")).alias("density"), note.alias("note"))
