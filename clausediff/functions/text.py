"""Text projections as Column expressions. White space is Python's: Unicode white space and
U+001C to U+001F, which takes the (?U) flag here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The same characters one by one, as trim() takes them: a pattern would be tried at every character of a text.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Those but the space. Runs that are no single space are what changes when white space is normalised.
_ODD = "".join(c for c in BLANKS if c < "\u0100" and c != " ") + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = f"[{_ODD}][ {_ODD}]*| [ {_ODD}]+"
_SOLID = "".join(map(chr, range(0x21, 0x7F)))
# Fixed value: titles that make an article a definition.
DEFINITION = r"(?iu)giải thích từ ngữ|định nghĩa|diễn giải"
# Texts shown for a status.
STATUS_LABELS = {"unchanged": "Khong doi", "changed": "Sua doi", "added": "Them moi", "removed": "Xoa bo"}
STATUS_ICONS = {"unchanged": "🟢", "changed": "🟡", "added": "🔵", "removed": "🔴"}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_value(c: Column) -> Column:
    """strip() of a column that may be read several times: most texts begin and end with a printable
    ASCII character, and then there is nothing to cut. btrim() walks the whole text to see that."""
    solid = lambda x: F.contains(F.lit(_SOLID), x)
    return F.when(solid(F.left(c, F.lit(1))) & solid(F.right(c, F.lit(1))), c).otherwise(strip(c))


def normalize_ws(c: Column) -> Column:
    """White space runs to one space, ends cut; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _RUN, " "))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts, null as empty, agree but for white space; equal ones aren't normalised."""
    return F.when(F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")), True).otherwise(normalize_ws(a) == normalize_ws(b))


def normalize_text(c: Column) -> Column:
    """No-break spaces, line ends, blanks and empty lines normalised; ends cut."""
    steps = (("\u00a0", " "), (r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    marks = ("\u00a0", "\r", "\t", "  ", "\n\n\n")  # without any of them no step changes a text
    odd = reduce(Column.__or__, [F.contains(c, F.lit(m)) for m in marks])
    return strip(F.when(~odd, c).otherwise(reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)))


def shorten(c: Column, most: int = 240) -> Column:
    return cut(normalize_ws(c), most)


def cut(t: Column, most: int = 240) -> Column:
    """shorten() of a text whose white space is normalised."""
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def diff_excerpt(c: Column, start: Column, end: Column, window: int = 120) -> Column:
    """The text around [start, end), 0-based, at most 300 characters."""
    left = F.greatest(F.lit(0), start - window)
    right = F.least(F.length(c), end + window)
    return shorten(F.substring(c, left + 1, F.greatest(F.lit(0), right - left)), 300)


def clean_heading(c: Column) -> Column:
    return F.rtrim(strip(c), F.lit(BLANKS + ":"))


def heading_level(style_name: Column, style_id: Column) -> Column:
    def level(c):
        return F.nullif(F.regexp_extract(F.lower(F.regexp_replace(c, rf"(?U){SPACE}+", "")), r"^heading(\d+)\z", 1), F.lit(""))

    return F.coalesce(level(style_name), level(style_id)).cast("int")


def to_roman(n: Column) -> Column:
    n = F.greatest(F.lit(1), n)
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    pick = lambda names, unit: F.array(*map(F.lit, names))[(F.floor(n / unit) % 10).cast("int")]
    return F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        pick(digits("C", "D", "M"), 100), pick(digits("X", "L", "C"), 10), pick(digits("I", "V", "X"), 1),
    )


def to_letters(n: Column, upper: bool) -> Column:
    """Bijective base 26. Six letters cover every int."""
    n = F.greatest(F.lit(1), n).cast("long")
    first = "A" if upper else "a"
    parts, below = [], 0
    for i in range(7):
        below = below * 26 + 1  # the smallest number with i + 1 letters
        digit = F.floor((n - below) / 26**i) % 26
        parts.append(F.when(n >= below, F.char(digit + ord(first))).otherwise(""))
    return F.concat(*reversed(parts))


def format_counter(n: Column, num_fmt: Column) -> Column:
    return (
        F.when(num_fmt.isin("upperRoman", "romanUpper"), to_roman(n))
        .when(num_fmt.isin("lowerRoman", "romanLower"), F.lower(to_roman(n)))
        .when(num_fmt == "upperLetter", to_letters(n, True))
        .when(num_fmt == "lowerLetter", to_letters(n, False))
        .otherwise(n.cast("string"))
    )


def article_sort_key(no: Column) -> Column:
    """Numbers with an optional letter suffix first, by number; then the rest by text."""
    numeric = no.rlike(r"^[0-9]+[A-Za-z]*\z")
    return F.struct(
        F.when(numeric, 0).otherwise(1).alias("kind"),
        F.when(numeric, F.regexp_extract(no, r"^([0-9]+)", 1).cast("decimal(38,0)")).alias("number"),
        F.when(numeric, F.regexp_extract(no, r"^[0-9]+(.*)", 1)).otherwise(no).alias("rest"),
    )


def distance_similarity(d: Column) -> Column:
    return F.when(d.isNull(), 0.0).otherwise(1.0 / (1.0 + d))


def search_score(d: Column) -> Column:
    return 1.0 - d


def first_json_object(c: Column) -> Column:
    """The whole text as JSON, or else what stands from its first to its last brace; a variant or null."""
    return F.coalesce(F.try_parse_json(strip(c)), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def status_from_texts(before: Column, after: Column) -> Column:
    return (
        F.when(before == after, "unchanged").when((before != "") & (after != ""), "changed").when(before != "", "removed").otherwise("added")
    )


def status_of_pair(before: Column, after: Column) -> Column:
    """status_from_texts() of both texts with white space normalised; only differing ones are, and only to see if they are blank."""
    has = lambda c: F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit("")) != ""
    return F.when(same_text(before, after), "unchanged").when(has(before) & has(after), "changed").when(has(before), "removed").otherwise("added")


def line_refs(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: x.cast("string")), ", ")).otherwise("-")


def chunk_type(title: Column) -> Column:
    return F.when(title.rlike(DEFINITION), "definition").otherwise("article")


def from_map(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]
