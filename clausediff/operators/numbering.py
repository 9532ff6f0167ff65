"""List numbering of DOCX paragraphs: style inheritance, counters, labels, display text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.text import format_counter, heading_level, normalize_text, normalize_ws, strip
from clausediff.sources.files import stored

KEY = ["doc_id", "version"]
LEVELS = 9
#: Positions of a document that are counted in one task.
BLOCK = 65_536


def resolve_styles(styles: DataFrame) -> DataFrame:
    """doc_id, version, style_id, num_id, ilvl: each style's own numbering or the nearest
    one up its basedOn chain (level 0 where that has none).

    Pointer doubling: after a round each open style has seen twice as many of its ancestors, and
    what it hasn't found yet it asks the last of them. A chain of n styles takes log2(n)
    rounds, each stored as a table. No chain is longer than its document has styles, so one that
    closes a cycle ends, without numbering, when that many ancestors are seen."""
    own = styles.dropDuplicates([*KEY, "style_id"])
    up = F.when(F.col("num_id").isNull(), F.col("based_on"))
    state = stored(own.select(*KEY, "style_id", up.alias("up"), "num_id", F.when(F.col("num_id").isNotNull(), F.coalesce("ilvl", F.lit(0))).alias("ilvl")), "styles")
    most = state.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    seen = 1
    while seen < most and not state.where("up is not null").isEmpty():
        asked = state.select(*KEY, F.col("style_id").alias("up"), F.col("up").alias("a_up"), F.col("num_id").alias("a_num"), F.col("ilvl").alias("a_lvl"))
        met = state.join(asked, [*KEY, "up"], "left")
        state = stored(met.select(*KEY, "style_id", F.col("a_up").alias("up"), F.coalesce("num_id", "a_num").alias("num_id"), F.coalesce("ilvl", "a_lvl").alias("ilvl")), "styles")
        seen *= 2
    return state.where("num_id is not null").select(*KEY, "style_id", "num_id", "ilvl")


def style_numbering(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """paragraphs with num_id and ilvl from their style where they have no num_id of their own. A document's
    styles meet its paragraphs as one map, so paragraphs that lie by document stay where they are."""
    given = resolve_styles(styles).where("version is not null and style_id is not null")
    given = given.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("version", "style_id"), F.struct("num_id", "ilvl")))).alias("_styles"))
    out = paragraphs.join(given, "doc_id", "left").withColumn("_s", F.col("_styles")[F.struct("version", "style_id")])
    out = out.withColumn("ilvl", F.when(F.col("num_id").isNull(), F.col("_s.ilvl")).otherwise(F.col("ilvl")))
    return out.withColumn("num_id", F.coalesce("num_id", "_s.num_id")).drop("_styles", "_s")


def _by_document(paragraphs: DataFrame) -> tuple[DataFrame, bool]:
    """paragraphs, where no document is longer than BLOCK positions dealt by document, so that all
    steps that follow find them in place and texts move once; and whether one is longer. Dealt by
    doc_id alone, which holds for both versions and where a plan knows the only version."""
    long = not paragraphs.where(F.col("idx") >= BLOCK).isEmpty()
    return paragraphs if long else paragraphs.repartition("doc_id"), long


def _counted(paragraphs: DataFrame, long: bool) -> DataFrame:
    """paragraphs with _n0, _n1, …: how often each level of the paragraph's list has come since it was last reset.

    A level is reset by each one above it, so what counts is how often it came in all less how often
    it had come at its last reset, and both are running values of one order: one sort. A list is
    counted in blocks of BLOCK positions, which may lie in different tasks; a block's totals and
    its counts at the last resets combine associatively, so a running sum and a running maximum over a
    list's blocks, a row each, give what comes before a block."""
    list_key = [*KEY, "num_id"]
    p = paragraphs.withColumn("_b", F.floor(F.col("idx") / BLOCK))
    order = Window.partitionBy(*list_key, "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    levels = range(LEVELS)
    p = p.select("*", *[F.sum(F.when(F.col("ilvl") == i, 1).otherwise(0)).over(order).alias(f"_t{i}") for i in levels])
    p = p.select("*", *[F.max(F.when(F.col("ilvl") < i, F.col(f"_t{i}"))).over(order).alias(f"_s{i}") for i in levels])
    held = [F.lit(0)] * LEVELS
    if long:
        blocks = p.where("num_id is not null").groupBy(*list_key, "_b").agg(*[F.max(f"_{k}{i}").alias(f"_{k}{i}") for k in "ts" for i in levels])
        before = Window.partitionBy(*list_key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*list_key, "_b", *[f"_s{i}" for i in levels], *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_a{i}") for i in levels])
        at_reset = [F.coalesce(F.max(F.col(f"_a{i}") + F.col(f"_s{i}")).over(before), F.lit(0)) for i in levels]
        p = p.join(blocks.select(*list_key, "_b", *[(F.col(f"_a{i}") - r).alias(f"_h{i}") for i, r in enumerate(at_reset)]), [*list_key, "_b"], "left")
        held = [F.coalesce(f"_h{i}", F.lit(0)) for i in levels]
    counts = [F.when(F.col(f"_s{i}").isNull(), F.col(f"_t{i}") + held[i]).otherwise(F.col(f"_t{i}") - F.col(f"_s{i}")) for i in levels]
    return p.select(*paragraphs.columns, *[c.alias(f"_n{i}") for i, c in enumerate(counts)])


def numbering_labels(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (with num_id, ilvl) with numbering_label and numbering_path.

    A paragraph of level i counts up the counter i of its list and resets the deeper ones;
    its label is the level's text with the counters put in."""
    return _labelled(*_by_document(paragraphs), levels)


def _labelled(paragraphs: DataFrame, long: bool, levels: DataFrame) -> DataFrame:
    spec = levels.where("version is not null and num_id is not null").groupBy(*KEY, "num_id").agg(
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("start", "num_fmt", "lvl_text")))).alias("spec")
    )
    spec = spec.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("version", "num_id"), "spec"))).alias("_specs"))
    listed = F.col("num_id").isNotNull() & F.col("ilvl").isNotNull()
    p = _counted(paragraphs, long).join(spec, "doc_id", "left").withColumn("spec", F.col("_specs")[F.struct("version", "num_id")]).drop("_specs")
    for i in range(LEVELS):
        start = F.coalesce(F.col("spec")[i]["start"], F.lit(1))
        p = p.withColumn(f"_c{i}", F.when(listed & (F.col("ilvl") >= i) & (F.col(f"_n{i}") > 0), start - 1 + F.col(f"_n{i}")))
    counters = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_c{i}").cast("long").alias("n"), F.col("spec")[i]["num_fmt"].alias("f")) for i in range(LEVELS)])
    texts = F.transform(
        F.filter(counters, lambda x: x["n"].isNotNull()),
        lambda x: F.struct(F.concat(F.lit("%"), x["i"] + 1).alias("mark"), format_counter(x["n"], F.coalesce(x["f"], F.lit("decimal"))).alias("text")),
    )
    p = p.withColumn("_texts", texts)
    start = F.coalesce(F.col("spec")[F.col("ilvl")]["lvl_text"], F.concat(F.lit("%"), F.col("ilvl") + 1))
    label = F.aggregate("_texts", start, lambda acc, x: F.replace(acc, x["mark"], x["text"]))
    p = p.withColumn("numbering_label", F.when(listed, normalize_ws(label)))
    p = p.withColumn("numbering_path", F.when(listed, F.transform("_texts", lambda x: x["text"])).otherwise(F.array().cast("array<string>")))
    return p.drop("spec", "_texts", *[f"_{k}{i}" for k in "nc" for i in range(LEVELS)])


def display_text(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with heading_level and display_text: headings 1 to 3 get their label in front."""
    p = paragraphs.withColumn("heading_level", heading_level(F.col("style_name"), F.col("style_id")))
    labelled = F.col("heading_level").isin(1, 2, 3) & (F.coalesce("numbering_label", F.lit("")) != "")
    return p.withColumn("display_text", F.when(labelled, strip(F.concat_ws(" ", "numbering_label", "text"))).otherwise(F.col("text")))


def numbered_paragraphs(paragraphs: DataFrame, styles: DataFrame, levels: DataFrame) -> DataFrame:
    p, long = _by_document(paragraphs)
    return display_text(_labelled(style_numbering(p, styles), long, levels))


def normalize_paragraphs(paragraphs: DataFrame) -> DataFrame:
    p = paragraphs.withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
    shown = F.coalesce(F.nullif("display_text", F.lit("")), "text")
    return p.withColumn("display_text", normalize_text(shown)).where("display_text <> ''")


def normalize_document(paragraphs: DataFrame) -> DataFrame:
    """doc_id, version, text: the normalised paragraphs' display texts, a line each."""
    return document_texts(normalize_paragraphs(paragraphs))


def document_texts(normalized: DataFrame) -> DataFrame:
    """normalize_document() of paragraphs that are normalised."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "display_text")))
    return normalized.groupBy(*KEY).agg(F.array_join(F.transform(rows, lambda x: x["display_text"]), "\n").alias("text"))
