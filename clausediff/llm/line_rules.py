"""Line-first cleaning with built-in functions only.

Every line is judged on its own: punctuation (too many symbols, a line in capitals),
navigation (link lists with separators, short bits with a separator and no sentence mark) and
boilerplate phrases that make up a share of the line. Lines that fail are removed,
lines that repeat an earlier one too, and a document that loses too much of its text is
rejected. All work is inside one row: nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Phrases of notices and menus, in the languages of the documents.
BOILERPLATE = (
    "accept all cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|"
    "enable javascript|javascript is disabled|sign up for our newsletter|subscribe to our newsletter|"
    "click here to|share on facebook|log in to|lorem ipsum|"
    "accepter les cookies|politique de confidentialité|tous droits réservés|mentions légales|cliquez ici|"
    "cookies akzeptieren|datenschutzerklärung|alle rechte vorbehalten|newsletter abonnieren|klicken sie hier|"
    "aceptar cookies|política de privacidad|todos los derechos reservados|aviso legal|haga clic aquí"
)
#: A document is kept if at least this share of its word characters stays.
KEEP_SHARE = 0.5
#: A line may consist of symbols up to this share.
SYMBOL_SHARE = 0.08
#: A line is boilerplate if such phrases make up this share of it.
NOTICE_SHARE = 0.08


def _chars(text: Column) -> Column:
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \n\t\r\x0b\x0c", text)
    return F.length(bare).cast("long")


def _n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def line_passes(line: Column) -> Column:
    """True for a line that no rule fails. line: has a word. Cheap tests come first."""
    n = F.length(line)
    symbols, bars = F.regexp_count(line, F.lit(SYMBOL)), F.regexp_count(line, F.lit("[|»›·]"))
    shouted = (n >= 12) & (F.upper(line) == line) & (F.lower(line) != line)
    listed = (bars >= 2) & (bars * 40 > n)
    low = F.lower(line)
    notice = F.when(low.rlike(BOILERPLATE), n - F.length(F.regexp_replace(low, BOILERPLATE, "")) >= NOTICE_SHARE * n).otherwise(False)
    stub = (n < 30) & (bars >= 1) & ~line.rlike(r"[.!?…:;。！？]")
    return ~(shouted | (symbols > SYMBOL_SHARE * n) | listed | stub | notice)


def line_cleaned(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """docs (doc_id, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept_chars (word characters on lines that stay), cleaned (those lines,
    joined) and kept.

    Words are runs of characters other than U+0009-U+000D and U+0020. Null and empty texts
    have zeros, fail the base rules and are not kept. Windows of five words are compared by
    a 64-bit hash. Each row stands for itself; repeated rows give repeated results, an empty table
    gives none, and other columns of docs are left out."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    at = lambda i: F.get("wh", i)
    grams = F.transform(F.sequence(F.lit(0), F.size("wh") - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4)))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("grams", F.when(F.col("n_words") > 5, grams).otherwise(none)).drop("wh")
    pairs = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("s", F.when(twice, F.sort_array(pairs))).drop("grams")
    same = lambda x, i: (F.get("s", i - 1).getField("h") == x.getField("h")) | (F.get("s", i + 1).getField("h") == x.getField("h"))
    hits = F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x.getField("i"))
    d = d.withColumn("at", F.sort_array(hits)).drop("s")
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")),
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered.getField("n"), F.lit(0)).cast("long")).drop("at")

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    d = d.withColumn("once", F.array_distinct("lines"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size("once")).cast("long")).drop("lines")
    d = d.withColumn("cleaned", F.array_join(F.filter("once", line_passes), "\n")).drop("once")
    d = d.withColumn("word_chars", _chars(F.col("text"))).withColumn("n_symbols", _n_symbols(F.col("text")))
    d = d.withColumn("kept_chars", _chars(F.col("cleaned")))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("kept_chars") >= keep_share * F.col("word_chars"))
    d = d.withColumn("kept", kept).drop("text")
    # one row out of one: a filter on the result stays above it, and doesn't repeat the work of each step
    return d.select(F.inline(F.array(F.struct(*d.columns))))


_N = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_SOLID = r"length(regexp_replace({0}, '[\x20\x09-\x0D]', '', 'g'))"
#: The same in SQL: one row a document, one a window of words, one a line.
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
token as (select r, unnest(words) as x, generate_subscripts(words, 1) as i from w),
windows as (select r, i, x, lead(x, 1) over o as x1, lead(x, 2) over o as x2, lead(x, 3) over o as x3, lead(x, 4) over o as x4 from token window o as (partition by r order by i)),
found as (select r, i, count(*) over (partition by r, x, x1, x2, x3, x4) as times from windows where x4 is not null),
covered as (select r, sum(least(5, i - before)) as n from (select r, i, coalesce(lag(i) over (partition by r order by i), i - 5) as before from found where times > 1) group by r),
line as (select r, x, length(x) as n, lower(x) as low, {_N.format('x', '|»›·')} as bars, {_N.format('x', '#*$%&|<>')} as symbols from (select r, unnest(list_distinct(lines)) as x from w)),
stays as (select r, sum({_SOLID.format('x')}) as chars from line where not (
    (n >= 12 and upper(x) = x and low <> x) or symbols > {SYMBOL_SHARE} * n or (bars >= 2 and bars * 40 > n) or (n < 30 and bars >= 1 and not regexp_matches(x, '[.!?…:;。！？]'))
    or (regexp_matches(low, '{BOILERPLATE}') and n - length(regexp_replace(low, '{BOILERPLATE}', '', 'g')) >= {NOTICE_SHARE} * n)) group by r),
base as (select doc_id, len(words)::bigint as n_words, {_SOLID.format('t')} as word_chars, {_N.format('t', '#*$%&|<>')} as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(chars, 0) as chars from w left join covered using (r) left join stays using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and chars >= {KEEP_SHARE} * word_chars as kept
from base
"""
