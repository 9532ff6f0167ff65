"""Line predicates of statutes and contracts, on stripped lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How headings and items are written.
CHUONG = r"(?iUd)^Chương\s+([IVXLCDM\d]+)[\.:]?\s*(.*)"
MUC = r"(?iUd)^Mục\s+(\d+)[\.:]?\s*(.*)"
DIEU = r"(?Ud)^(?:Điều|ĐIỀU|dieu|DIEU)\s+((?:\d+[A-Za-z]?|[IVXLCDM]+))[\.:]?\s*(.*)$"
KHOAN = r"(?Ud)^(\d+)[\.)]\s*(.*)$"
DIEM = r"(?iUd)^([a-zđ])[\.)]\s*(.*)$"
# The same beginnings in a text of many lines, where white space must not run on into the next line.
_GAP = r"[\s&&[^\n]]+"
CHUONG_HEAD = rf"(?iU:Chương{_GAP}([IVXLCDM\d]+))"
MUC_HEAD = rf"(?iU:Mục{_GAP}(\d+))"
DIEU_HEAD = rf"(?U:(?:Điều|ĐIỀU|dieu|DIEU){_GAP}(?:\d+[A-Za-z]?|[IVXLCDM]+))"
KHOAN_HEAD = r"(?U:\d+[\.)])"
KHOAN_NUMBER = r"(?U)^(\d+)"
DIEM_HEAD = r"(?iU:[a-zđ][\.)])"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"
#: A heading doesn't end so, has so many words, and is no longer than this.
NO_HEADING_END = r"[.;,:]\z"
HEADING_WORDS, HEADING_CHARS = (2, 14), 120
#: The share of capitals among the letters of a heading in capitals.
CAPITALS = 0.8
#: What a title-case heading doesn't hold, what its words consist of, and how one doesn't begin.
NO_TITLE = "[\"'()\\-•*]"
NO_WORD_CHAR = r"[^\p{L}\p{N}_À-ỹĐđ-]"
NO_HEADING_START = "^[(\\-•*\"“]"
KINDS = (("chuong", CHUONG), ("muc", MUC), ("dieu", DIEU), ("khoan", KHOAN), ("diem", DIEM))


def before_line(head: str) -> str:
    """The line end before a line that begins so."""
    return rf"\n(?={head})"


def line_kind(c: Column) -> Column:
    """The first of KINDS that fits, else 'text'."""
    out = F.lit("text")
    for name, pattern in reversed(KINDS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def line_number(c: Column, kind: Column) -> Column:
    return _group(c, kind, 1)


def line_rest(c: Column, kind: Column) -> Column:
    return _group(c, kind, 2)


def _group(c: Column, kind: Column, i: int) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in KINDS:
        out = F.when(kind == name, F.regexp_extract(c, pattern, i)).otherwise(out)
    return out


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _possible(c: Column) -> Column:
    return (c != "") & ~c.rlike(NO_HEADING_END) & ~c.rlike(DIGIT)


def upper_heading(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(c, r"\P{Lu}", ""))
    return _possible(c) & F.size(_words(c)).between(*HEADING_WORDS) & (letters > 0) & (capitals >= CAPITALS * letters)


def title_heading(c: Column) -> Column:
    words = F.filter(F.transform(_words(c), lambda w: F.regexp_replace(w, NO_WORD_CHAR, "")), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return _possible(c) & ~c.rlike(NO_TITLE) & F.size(words).between(*HEADING_WORDS) & (capital >= F.greatest(F.lit(HEADING_WORDS[0]), F.size(words) - 1))


def contract_heading(c: Column) -> Column:
    return (line_kind(c) == "text") & ~c.rlike(NO_HEADING_START) & (F.length(c) <= HEADING_CHARS) & (upper_heading(c) | title_heading(c))
