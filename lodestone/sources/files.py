"""File ingestion: parsers by extension over ``binaryFile`` rows, and chunks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.robots import judge

# Tags whose text is skipped, and tags that break lines.
SKIP_TAGS = frozenset("script style noscript svg canvas nav footer header aside".split())
BLOCK_TAGS = frozenset("p div section article main li h1 h2 h3 h4 h5 h6 br hr tr blockquote pre".split())
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
#: Bytes of text that are cut at a time.
CUT_BYTES = 1 << 21
SEPARATORS = ("\n\n", "\n", ". ", " ")
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.hidden.append(tag)
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")
        elif tag == "meta":
            a = dict(attrs)
            name = (a.get("name") or a.get("property") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"].strip())

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> tuple[str, dict[str, str]]:
    """Visible text, one line a block, and metadata (description, publish date)."""
    p = _Visible()
    p.feed(html)
    p.close()
    lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(p.parts).split("\n"))
    meta = {"description": p.meta.get("description") or p.meta.get("og:description", "")}
    meta["publish_date"] = next((p.meta[k] for k in ("article:published_time", "date", "pubdate") if k in p.meta), "")
    return "\n".join(x for x in lines if x), {k: v for k, v in meta.items() if v}


def decode(content: bytes) -> str:
    """By declared charset, byte order mark, UTF-8, else Latin-1."""
    m = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", content[:4096], re.IGNORECASE)
    for name in ([m[1].decode("ascii")] if m else []) + (["utf-16"] if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ["utf-8-sig"]):
        try:
            return content.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return content.decode("latin-1")


def docx_text(content: bytes) -> str:
    """Paragraphs, headings marked by their level, then table rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD_NS}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD_NS}t")).strip()
    out = []
    for p in body.findall(f"{_WORD_NS}p"):
        style = p.find(f"{_WORD_NS}pPr/{_WORD_NS}pStyle")
        level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_WORD_NS}val", "")) if style is not None else None
        if t := text(p):
            out.append(f"{'#' * int(level[1])} {t}" if level else t)
    for table in body.findall(f"{_WORD_NS}tbl"):
        for row in table.findall(f"{_WORD_NS}tr"):
            out.append(" | ".join(text(c) for c in row.findall(f"{_WORD_NS}tc")))
    return "\n\n".join(x for x in out if x.strip())


def pdf_text(content: bytes) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("PDF files need the package pypdf") from e
    pages = ((p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(content)).pages)
    return "\n\n".join(p for p in pages if p)


def plain_text(content: bytes) -> str:
    return content.decode("utf-8").strip()


#: Parser of each kind; register more here.
PARSERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "docx": docx_text, "html": lambda b: html_text(decode(b))[0], "text": plain_text}


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters cut at the coarsest separator that helps, separators kept with what they
    end; consecutive chunks share ``overlap`` characters, which may take a chunk beyond ``size``. Blank ones go."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    out: list[str] = []
    held = ""
    for piece in _pieces(text, size, 0):
        if held and len(held) + len(piece) > size:
            out.append(held)
            held = held[-overlap:] if overlap else ""
        held += piece
    return [c for c in [*out, held] if c.strip()]


def _pieces(text: str, size: int, level: int) -> Iterator[str]:
    """Greedy runs of parts that fit; a part that doesn't is cut at the next separator, in the end anywhere."""
    if level == len(SEPARATORS):
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    sep, held = SEPARATORS[level], ""
    parts = text.split(sep)
    for part in [p + sep for p in parts[:-1]] + parts[-1:]:
        if len(held) + len(part) > size:
            if held:
                yield held
            held = ""
            if len(part) > size:
                yield from _pieces(part, size, level + 1)
                continue
        held += part
    if held:
        yield held


def chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``docs`` (document_id, text) -> ``document_id, chunk_index, content``. No exchange: a document is cut where it is.

    A batch is cut in runs of ``CUT_BYTES`` of text, or one more document, and these chunks go on before the next run.
    """
    schema = T.StructType([docs.schema["document_id"], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field("document_id").type
            upto = np.cumsum(np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)))
            i = 0
            while i < batch.num_rows:
                n = max(1, int(np.searchsorted(upto[i:], (upto[i - 1] if i else 0) + CUT_BYTES, "right")))
                part = batch.slice(i, n)
                rows = [(d, j, c) for d, t in zip(part.column("document_id").to_pylist(), part.column("text").to_pylist()) for j, c in enumerate(chunk_text(t or "", size, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=schema.names)
                i += n

    return docs.select("document_id", "text").mapInArrow(run, schema)


def ingest(spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Documents (``document_id, filename, content_type, file_size, text, error``) and chunks of all files below ``path``.

    A file that can't be parsed has a null text and its error; a text that occurs again is kept once, by file name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content")
    files = files.withColumn("parser", X.parser_of(F.col("filename"))).withColumn("content_type", X.content_type(F.col("filename")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b["parser"], b["content"]):
                try:
                    texts.append(PARSERS[kind](bytes(content)) if kind in PARSERS else None)
                    errors.append(None if kind in PARSERS else "unsupported file type")
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield b.drop(columns=["content", "parser"]).assign(text=texts, error=errors)

    parsed = files.mapInPandas(run, "filename string, file_size bigint, content_type string, text string, error string")
    markdown = F.lower("filename").endswith(".md")
    parsed = parsed.withColumn("text", F.when(markdown, F.trim(X.strip_markdown(F.col("text")))).otherwise(F.col("text")))
    hashed = parsed.withColumn("document_id", F.coalesce(F.sha2("text", 256), F.sha2("filename", 256)))
    first = hashed.groupBy("document_id").agg(F.min_by(F.struct("filename", "content_type", "file_size", "text", "error"), "filename").alias("d")).select("document_id", "d.*")
    return first, chunks(first.where("text is not null"), size, overlap)


#: Bytes of a page beyond which it is refused.
MAX_PAGE = 10 * 1024 * 1024


def scrape(pages: DataFrame, robots: DataFrame | None = None, most: int = MAX_PAGE) -> DataFrame:
    """``pages`` (page_id, url, html) -> title, visible text and description of the pages with a safe url, of at most
    ``most`` bytes and, where ``robots`` (origin, content) are given, not forbidden by their site."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [html_text(h or "") for h in b["html"]]
            yield b.drop(columns=["html"]).assign(text=[t for t, _ in found], description=[m.get("description") for _, m in found])

    pages = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) <= most)
    if robots is not None:
        pages = judge(pages, robots).where(F.coalesce("robots_allowed", F.lit(True)))
    safe = pages.where(X.is_safe_url(F.col("url"))).select("page_id", "url", X.html_title(F.col("html")).alias("title"), "html")
    return safe.mapInPandas(run, "page_id bigint, url string, title string, text string, description string").withColumn("filename", X.url_filename(F.col("url")))


def robots_allows(robots: str, path: str, agent: str) -> bool:
    """Prefix rules of a robots.txt: those of the agent's own group if it has one, else of ``*``."""
    groups: dict[str, list[str]] = {}
    names: list[str] = []
    fresh = True
    for line in robots.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = names + [value.lower()] if not fresh else [value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
        elif key in ("disallow", "allow"):
            fresh = True
            if key == "disallow" and value:
                for n in names:
                    groups[n].append(value)
    own = next((g for g in groups if g != "*" and g in agent.lower()), "*")
    return not any(path.startswith(p) for p in groups.get(own, []))
