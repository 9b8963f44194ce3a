"""Pages, sections, paragraphs and overlapping chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import location_label, strip

#: Section headings in order of precedence; fixed values.
SECTION_PATTERNS = [
    r"^(?:ARTICLE|SECTION|PART)\s+[IVXLCDM\d]+[.:]\s*(.+)$",
    r"^(\d+\.)\s+([A-Z][A-Z\s]+)$",
    r"^(\d+\.\d+)\s+(.+)$",
    r"^([A-Z][A-Z\s]{2,})$",
    r"^((?:EXHIBIT|SCHEDULE|APPENDIX)\s+[A-Z\d]+)",
]
SECTION = "(?Ud)" + "|".join(SECTION_PATTERNS)
BLANK_LINE = r"(?U)\n\s*\n"
CHARS_PER_PAGE, CHUNK_SIZE, OVERLAP = 3000, 4000, 200


def paginate(docs: DataFrame, chars_per_page: int = CHARS_PER_PAGE) -> DataFrame:
    """(doc_id, page, text): paragraphs gathered greedily into pages.

    A page closes where the next paragraph would exceed its size, the separator before
    that paragraph not counted. Paragraphs stream past in the order they have in their
    document, which is a row, so nothing is shuffled and one page is held at a time.
    """
    parts = docs.select("doc_id", F.posexplode(F.split("raw_text", "\n\n")).alias("place", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        doc, page, held, size = None, 1, [], 0

        def close(last: bool) -> None:
            text = "\n\n".join(held).strip()
            if text or not last:
                out.append((doc, page, text))

        for b in batches:
            for of, place, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if place == 0:
                    close(True)
                    doc, page, held, size = of, 1, [], 0
                if size and size + len(part) > chars_per_page:
                    close(False)
                    page, held, size = page + 1, [part], len(part)
                elif size:
                    held.append(part)
                    size += 2 + len(part)
                else:
                    held, size = [part], len(part)
            yield _rows(out, kinds)
            out.clear()
        close(True)
        yield _rows(out, kinds)

    kinds = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("page int, text string").fields])
    return parts.mapInArrow(run, kinds)


def _rows(rows: list[tuple], kinds: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kinds)], names=kinds.names)


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): the pages a document came with (an array column ``pages``),
    else those of paginate()."""
    if "pages" not in docs.columns:
        return paginate(docs)
    own = docs.where("pages IS NOT NULL").select("doc_id", F.posexplode("pages").alias("page", "text"))
    return own.withColumn("page", F.col("page") + 1).unionByName(paginate(docs.where("pages IS NULL")))


def heading(line: Column) -> Column:
    return (line != "") & line.rlike(SECTION)


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, name): lines that look like headings; lines count from 0."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "name"))
    return lines.withColumn("name", strip(F.col("name"))).where(heading(F.col("name")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text): parts between blank lines, in order within a page."""
    return pages.select("doc_id", "page", F.posexplode(_parts()).alias("ord", "text"))


def _parts() -> Column:
    return F.filter(F.transform(F.split("text", BLANK_LINE), strip), lambda p: p != "")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, sections): the same with the names of the page's sections
    that contain them or are contained, without a join; a page without text has one row
    whose text is null."""
    heads = F.filter(F.transform(F.split("text", "\n"), strip), heading)
    # headings first: beside the generator they would be sought once for each paragraph
    rows = pages.withColumn("heads", heads).select("doc_id", "page", "heads", F.posexplode_outer(_parts()).alias("ord", "text"))
    return rows.select("doc_id", "page", "ord", "text", F.filter("heads", lambda h: F.contains("text", h) | F.contains(h, F.col("text"))).alias("sections"))


def paragraph_sections(paras: DataFrame, heads: DataFrame) -> DataFrame:
    """Paragraphs with the names of their page's sections that contain them or are
    contained: a page's headings are listed before the join, so texts are shuffled once
    and are no keys. Where both come from the same pages, page_paragraphs() needs no join."""
    s = heads.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("heads"))
    met = F.filter("heads", lambda h: F.contains("text", h["name"]) | F.contains(h["name"], F.col("text")))
    names = F.coalesce(F.transform(met, lambda h: h["name"]), F.array().cast("array<string>"))
    return paras.join(s, ["doc_id", "page"], "left").select("doc_id", "page", "ord", "text", names.alias("sections"))


def overlap_tail(text: str, overlap: int) -> str:
    """The end of a chunk that the next one repeats, from a sentence's start if it has one."""
    if len(text) <= overlap:
        return text
    tail = text[-overlap:]
    cut = max(tail.rfind(mark) for mark in (". ", ".\n", ".\t"))
    if cut > 0:
        return tail[cut + 2 :]
    cut = tail.find("\n\n")
    return tail[cut + 2 :] if cut > 0 else tail


CHUNKS = "chunk_index int, total_chunks int, text string, start_page int, end_page int, sections array<string>"


class _Folder:
    """The chunks of one document, paragraph by paragraph; none is ever split."""

    def __init__(self, doc, size: int, overlap: int):
        self.doc, self.size, self.overlap = doc, size, overlap
        self.text, self.first, self.names, self.page, self.done = "", 1, [], 1, []

    def add(self, page: int, para: str | None, heads: list[str]) -> None:
        self.page = page
        if para is None:
            return
        longer = f"{self.text}\n\n{para}" if self.text else para
        if self.text and len(longer) > self.size:
            self._close(page)  # the page of the paragraph that did not fit
            tail = overlap_tail(self.text, self.overlap)
            self.text, self.first, self.names = f"{tail}\n\n{para}" if tail else para, page, list(heads)
        else:
            self.text = longer
            self.names += heads

    def _close(self, last: int) -> None:
        self.done.append((self.text.strip(), self.first, last, self.names))

    def rows(self) -> list[tuple]:
        if self.text.strip():
            self._close(self.page)
        return [(self.doc, k, len(self.done), *c) for k, c in enumerate(self.done)]


def _chunk_stream(paras: DataFrame, chunk_size: int, overlap: int) -> DataFrame:
    """Chunks of paragraphs that stream past document by document, in order."""
    kinds = T.StructType([paras.schema["doc_id"], *T._parse_datatype_string(CHUNKS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for b in batches:
            for doc, page, para, heads in zip(*(b.column(k).to_pylist() for k in range(4))):
                if at is None or doc != at.doc or page < at.page:
                    out += at.rows() if at else []
                    at = _Folder(doc, chunk_size, overlap)
                at.add(page, para, heads or [])
            yield _rows(out, kinds)
            out = []
        yield _rows(at.rows() if at else [], kinds)

    out = paras.select("doc_id", "page", "text", "sections").mapInArrow(run, kinds)
    return out.withColumns({"char_count": F.char_length("text"), "source_location": location_label(F.col("start_page"), F.col("end_page"))})


def chunk(paras: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, text, start_page, end_page, sections,
    char_count, source_location) of paragraphs with their sections, in any order.

    Each chunk depends on the overlap of the one before, so a document's paragraphs are
    brought together and sorted, and folded as they stream past: a task holds the chunks of
    one document.
    """
    return _chunk_stream(paras.repartition("doc_id").sortWithinPartitions("doc_id", "page", "ord"), chunk_size, overlap)


def chunk_documents(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of raw documents: pages, paragraphs, sections and chunks in one pass of their
    rows, without a shuffle."""
    return _chunk_stream(page_paragraphs(document_pages(docs)), chunk_size, overlap)


def chunk_totals(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("int"))


def is_heading(line: str) -> bool:
    return any(re.match(p, line) for p in SECTION_PATTERNS)
