"""Documents as sources: .docx and simple .pdf files to sections.

Files are read with Spark's binary source, so any store that Spark reads will
do; parsing runs per file on the executors. A file that can't be parsed gives a
row with ``error`` set, the others are unaffected.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.config import ParsingError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SECTION = "array<struct<section_id:string,heading:string,level:int,text:string,page_numbers:array<int>>>"
PARSED = f"doc_id string, title string, sections {SECTION}, metadata map<string,string>, error string"


def heading_level(style: str) -> int:
    """N of "Heading N", 1 of "Title", else 0."""
    if style.startswith("Heading"):
        number = style[len("Heading") :].strip()
        return int(number) if number.isdigit() else 0
    return 1 if style == "Title" else 0


def paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style name, text) of a .docx file's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "") or ""
        out = []
        for p in ET.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
            style = p.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            name = names.get(key, key) or ""
            name = re.sub(r"^heading", "Heading", name)
            name = re.sub(r"^Heading(\d)", r"Heading \1", name)
            out.append((name, "".join(t.text or "" for t in p.iter(f"{_W}t"))))
        return out


def docx(data: bytes, stem: str) -> tuple[str, list[dict], dict]:
    """Title, sections and metadata. Each heading opens a section; text before
    the first is "Introduction" of level 1."""
    try:
        paras = paragraphs(data)
    except (KeyError, zipfile.BadZipFile, ET.ParseError) as e:
        raise ParsingError(f"not a .docx file: {e}") from e
    texts = [(s, t.strip()) for s, t in paras if t.strip()]
    tops = [t for s, t in texts if s.startswith("Heading 1") or s == "Title"]
    title = tops[0] if tops else texts[0][1][:100] if texts else stem
    sections: list[dict] = []
    for style, text in texts:
        level = heading_level(style)
        if level > 0:
            sections.append({"heading": text, "level": level, "body": []})
        else:
            if not sections:
                sections.append({"heading": "Introduction", "level": 1, "body": []})
            sections[-1]["body"].append(text)
    rows = [{"section_id": f"s{k}", "heading": s["heading"], "level": s["level"], "text": "\n".join(s["body"]), "page_numbers": []} for k, s in enumerate(sections, 1)]
    return title, rows, {"paragraphs": str(len(paras)), "sections": str(len(rows))}


_SHOW = re.compile(rb"/([^\s/()<>\[\]]+)\s+[-\d.]+\s+Tf|(\((?:\\.|[^\\()])*\))|(<[0-9A-Fa-f\s]*>)|(?<![A-Za-z])(Tj|TJ|Td|TD|T\*|ET|')(?![A-Za-z])", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"", b"t": b"\t", b"b": b"", b"f": b""}


class _Pdf:
    """The objects of a file, those in object streams too, and its fonts' maps to
    Unicode."""

    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            self.objects[int(m[1])] = m[2]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body and (head := re.search(rb"/N\s+(\d+)", body)) and (first := re.search(rb"/First\s+(\d+)", body)):
                inner, at = self.stream(body), int(first[1])
                numbers = list(map(int, inner[:at].split()))[: 2 * int(head[1])]
                starts = [at + x for x in numbers[1::2]] + [len(inner)]
                for k, number in enumerate(numbers[::2]):
                    self.objects.setdefault(number, inner[starts[k] : starts[k + 1]])
        self.fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
        for body in self.objects.values():
            for name, number in re.findall(rb"/([^\s/()<>\[\]]+)\s+(\d+)\s+\d+\s+R", body):
                font = self.objects.get(int(number), b"")
                if found := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font):
                    self.fonts[name] = _unicode_map(self.stream(self.objects.get(int(found[1]), b"")))

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return m[1]

    def text(self, stream: bytes) -> str:
        """Text that a content stream shows, a line for each text positioning."""
        out: list[str] = []
        font = None
        for m in _SHOW.finditer(stream):
            name, literal, hexa, operator = m.groups()
            if name is not None:
                font = self.fonts.get(name)
            elif literal is not None:
                out.append(_shown(_literal(literal[1:-1]), font))
            elif hexa is not None and hexa[1:-1].strip():
                digits = re.sub(r"\s", "", hexa[1:-1].decode())
                out.append(_shown(bytes.fromhex(digits + "0" * (len(digits) % 2)), font))
            elif operator in (b"Td", b"TD", b"T*", b"ET", b"'") and out and out[-1] != "\n":
                out.append("\n")
        return "".join(out).strip()


def _literal(body: bytes) -> bytes:
    """A literal string's bytes: escapes and octal codes."""
    replace = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r") else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", replace, body, flags=re.S)


def _shown(codes: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if font is None:
        return codes.decode("latin-1")
    width, table = font
    return "".join(table.get(int.from_bytes(codes[k : k + width], "big"), "") for k in range(0, len(codes), width))


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes a code and the text of each code, of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    spaces = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    width, table = (len(spaces[1]) // 2 if spaces else 2), {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            if several:
                table.update(zip(range(int(a, 16), int(b, 16) + 1), map(text, re.findall(rb"<([0-9A-Fa-f]+)>", several))))
            else:
                start = int(one, 16)
                table.update({k: text(b"%0*X" % (len(one), start + k - int(a, 16))) for k in range(int(a, 16), int(b, 16) + 1)})
    return width, table


def pdf(data: bytes, stem: str) -> tuple[str, list[dict], dict]:
    """A section for each page that shows text. Reads plain and Flate streams, of
    fonts that have a map to Unicode or simple codes; other files fail as unsupported."""
    if not data.startswith(b"%PDF"):
        raise ParsingError("not a .pdf file")
    file = _Pdf(data)
    pages = [file.text(body) for _, o in sorted(file.objects.items()) if b"/ObjStm" not in o and b"BT" in (body := file.stream(o)) and b"beginbf" not in body]
    rows = [{"section_id": f"s{k}", "heading": f"Page {k}", "level": 1, "text": t, "page_numbers": [k]} for k, t in enumerate(pages, 1) if t]
    if not rows:
        raise ParsingError("no text found, or its encoding is unsupported")
    found = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", b"\n".join([data, *file.objects.values()]), re.S)
    title = _literal(found[1]).decode("latin-1").strip() if found else ""
    return title or rows[0]["text"].split("\n")[0][:100] or stem, rows, {"pages": str(len(pages))}


def docx_bytes(paras: list[tuple[str, str]]) -> bytes:
    """A .docx file of (style, text) paragraphs."""
    ns = f'xmlns:w="{_W[1:-1]}"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(s)}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def pdf_bytes(pages: list[list[str]], title: str = "") -> bytes:
    """A .pdf file of pages of lines, in a simple font's codes."""
    code = lambda t: re.sub(rb"([\\()])", rb"\\\1", t.encode("latin-1", "replace"))
    out = [b"%PDF-1.4\n1 0 obj <</Title (" + code(title) + b")>> endobj\n"]
    for k, lines in enumerate(pages, 2):
        body = zlib.compress(b"BT /F1 12 Tf " + b" 0 -14 Td ".join(b"(" + code(t) + b") Tj" for t in lines) + b" ET")
        out.append(b"%d 0 obj <</Length %d /Filter /FlateDecode>>\nstream\n" % (k, len(body)) + body + b"\nendstream endobj\n")
    return b"".join(out)


def parse(data: bytes, path: str) -> tuple[str, list[dict], dict]:
    kind = path.rsplit(".", 1)[-1].lower()
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if kind == "docx":
        return docx(data, stem)
    if kind == "pdf":
        return pdf(data, stem)
    raise ParsingError(f"unsupported file type: {kind}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), title, sections, metadata and error of all files under ``path``."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def parsed(files: DataFrame) -> DataFrame:
    """The documents of (path, content) rows; what fails has its message in ``error``."""

    def run(frames):
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    title, sections, meta = parse(bytes(data), p)
                    rows.append((stem, title, sections, meta, None))
                except ParsingError as e:
                    rows.append((stem, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "sections", "metadata", "error"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def section_rows(parsed: DataFrame) -> DataFrame:
    """A row for each section of the documents that were parsed."""
    return parsed.filter("error is null").select("doc_id", "title", F.explode("sections").alias("s")).select("doc_id", "title", "s.section_id", "s.heading", "s.level", "s.text")


def page_sections(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, html) as documents: their title, and a section for each h1 to h6."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    title = F.trim(clean(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)))
    heads = F.regexp_extract_all(body, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), title.alias("title"), F.transform(heads, lambda h: F.trim(clean(h))).alias("headings"), F.trim(clean(body)).alias("text"))
