"""DOCX files as paragraph, style and numbering rows; only the bytes are read in Python."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.schemas import NUM_LEVELS, STYLES
from clausediff.sources.files import freed_shuffles, scratch

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Rows of small files that go to Spark together.
BATCH_ROWS = 4096
_PARTS = "kind string, idx int, text string, style_name string, style_id string, num_id int, ilvl int, based_on string, level int, start int, num_fmt string, lvl_text string"


def _val(node, path: str):
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(_W + "val")


def _int(x):
    return None if x is None else int(x)


def _text(p) -> str:
    """A paragraph's text: runs (those of links too), tabs and breaks."""
    out = []
    for run in [r for child in p for r in ([child] if child.tag == _W + "r" else child if child.tag == _W + "hyperlink" else [])]:
        for x in run:
            out.append((x.text or "") if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag in (_W + "br", _W + "cr") else "-" if x.tag == _W + "noBreakHyphen" else "")
    return "".join(out)


def parts_of(content: bytes):
    """Rows of one DOCX file: its styles, numbering levels and non-blank body paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        tree = lambda name: ET.fromstring(z.read(name)) if name in have else None
        styles, numbering, body = tree("word/styles.xml"), tree("word/numbering.xml"), tree("word/document.xml")
    names, default = {}, None
    for s in styles.iter(_W + "style") if styles is not None else ():
        if style_id := s.get(_W + "styleId"):
            num = s.find(f"{_W}pPr/{_W}numPr")
            names[style_id] = _val(s, _W + "name") or style_id
            if s.get(_W + "type") == "paragraph" and s.get(_W + "default") in ("1", "true"):
                default = style_id
            yield {"kind": "style", "style_id": style_id, "style_name": names[style_id], "based_on": _val(s, _W + "basedOn"), "num_id": _int(_val(num, _W + "numId")), "ilvl": _int(_val(num, _W + "ilvl"))}
    if numbering is not None:
        levels = {a.get(_W + "abstractNumId"): a.findall(_W + "lvl") for a in numbering.findall(_W + "abstractNum")}
        for n in numbering.findall(_W + "num"):
            for lvl in levels.get(_val(n, _W + "abstractNumId"), ()) if n.get(_W + "numId") else ():
                if (level := _int(lvl.get(_W + "ilvl"))) is not None:
                    yield {"kind": "level", "num_id": int(n.get(_W + "numId")), "level": level, "start": int(_val(lvl, _W + "start") or 1), "num_fmt": _val(lvl, _W + "numFmt") or "decimal", "lvl_text": _val(lvl, _W + "lvlText") or f"%{level + 1}"}
    for idx, p in enumerate(body.findall(f"{_W}body/{_W}p") if body is not None else ()):
        if text := _text(p).strip():
            own = p.find(_W + "pPr")
            style_id = _val(own, _W + "pStyle")
            style_id = style_id if style_id in names else default
            num = None if own is None else own.find(_W + "numPr")
            num_id, ilvl = (None, None) if num is None else (_int(_val(num, _W + "numId")), _int(_val(num, _W + "ilvl")) or 0)
            yield {"kind": "paragraph", "idx": idx, "text": text, "style_name": names.get(style_id), "style_id": style_id, "num_id": num_id, "ilvl": ilvl}


def docx_parts(files: DataFrame) -> DataFrame:
    """doc_id, version and a row for each part of files (doc_id, version, content)."""
    columns = "doc_id string, version string, " + _PARTS
    types = pa.schema([(c, pa.int32() if kind == "int" else pa.string()) for c, kind in map(str.split, columns.split(", "))])

    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(c.name) for r in rows], c.type) for c in types], schema=types)

    def run(batches):
        rows = []
        for batch in batches:
            for doc_id, version, content in zip(*batch.columns, strict=True):
                key = {"doc_id": doc_id.as_py(), "version": version.as_py()}
                rows += [key | part for part in parts_of(content.as_py())]
                if len(rows) >= BATCH_ROWS:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return files.select(F.col("doc_id").cast("string"), "version", "content").mapInArrow(run, columns)


def paragraph_counts(files: DataFrame) -> DataFrame:
    """files with, in place of their content, paragraphs: how many non-blank ones each file has, 0 without content."""
    rest = files.drop("content")
    names = [*rest.columns, "paragraphs"]

    def run(batches):
        for batch in batches:
            *columns, content = batch.columns
            n = [0 if c.as_py() is None else sum(part["kind"] == "paragraph" for part in parts_of(c.as_py())) for c in content]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names)

    return files.select(*rest.columns, "content").mapInArrow(run, rest.withColumn("paragraphs", F.lit(0).cast("long")).schema)


def docx_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, styles, numbering levels) of files (doc_id, version, content).

    Each file's bytes are read and parsed once: the parts go to a table in the shared scratch
    folder, partitioned by their kind, and each result reads its own partition of it."""
    parts, spark = docx_parts(files), files.sparkSession
    path = scratch(spark, "docx-parts")
    with freed_shuffles(spark):
        parts.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    paragraphs = parts.where("kind = 'paragraph'").select("doc_id", "version", "idx", "text", "style_name", "style_id", "num_id", "ilvl")
    return paragraphs, parts.where("kind = 'style'").select(*STYLES.names), parts.where("kind = 'level'").select(*NUM_LEVELS.names)
