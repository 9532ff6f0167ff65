"""Plain text as paragraph rows and as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.functions.text import strip
from clausediff.schemas import PARAGRAPHS

#: Where Python's splitlines() parts a text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def text_lines(texts: DataFrame) -> DataFrame:
    """doc_id, version, line_no, line: the non-blank lines of texts (doc_id, version, text), parted at \\n alone and stripped."""
    lines = texts.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).where("line <> ''")


def text_paragraphs(texts: DataFrame) -> DataFrame:
    """PARAGRAPHS rows of texts (doc_id, version, text): stripped non-blank lines, numbered by the original line."""
    lines = texts.select("doc_id", "version", F.posexplode(F.split("text", LINE_END)).alias("idx", "text"))
    lines = lines.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("display_text", F.col("text"))
    lines = lines.withColumn("numbering_path", F.array().cast("array<string>"))
    have = set(lines.columns)
    return lines.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PARAGRAPHS.fields])
