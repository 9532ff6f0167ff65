"""Results with evidence: no conclusion without a quotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausediff.functions.text import cut, first_json_object, normalize_ws, same_text, shorten, status_of_pair, strip
from clausediff.operators.diffing import with_diffs
from clausediff.schemas import ANNOTATION, EVIDENCE

STATUSES = ("unchanged", "changed", "added", "removed")
SEVERITIES = ("low", "medium", "high", "unknown")
# Conclusions and reasons as they appear in results.
UNCHANGED = "Khong ghi nhan khac biet ve mat van ban."
DEFAULTS = {
    "added": "Dieu khoan duoc bo sung trong v2.",
    "removed": "Dieu khoan bi loai bo so voi v1.",
    "changed": "Dieu khoan co thay doi noi dung giua v1 va v2.",
}
UNGROUNDED = "Khong du bang chung de ket luan; can kiem tra thu cong."
NO_MODEL, NO_MODEL_REASON = "Khong goi duoc LLM (missing ollama package).", "missing_ollama_package"
BAD_RESPONSE, BAD_REASON = "LLM fail (ValueError), fallback rule-based.", "LLM output is not valid JSON"
#: Task given with each prompt, in front of the article's own parts.
PROMPT = (
    "Nhiem vu: doi chieu hai ban v1 va v2 cua cung mot dieu trong hop dong.\n"
    "Can co: trang thai, ket luan ngan, trich dan lam bang chung, va y nghia cua tung block trong DIFF_BLOCKS.\n\n"
    "Dieu kien:\n"
    "1) Can cu duy nhat la hai van ban ben duoi; khong dung hieu biet khac.\n"
    "2) status la mot trong bon gia tri: unchanged, changed, added, removed.\n"
    "3) Khong trich duoc bang chung thi evidence la [] va conclusion noi rang khong du bang chung de ket luan.\n"
    "4) block_id trong diff_annotations phai lay tu DIFF_BLOCKS; khong dat ma moi.\n"
    "5) severity la mot trong: low, medium, high, unknown.\n"
    "6) Chi tra ve mot doi tuong JSON theo mau duoi day, khong kem chu nao khac.\n\n"
    'Mau JSON: {"status": "...", "conclusion": "...", "evidence": [{"tag": "changed|added|removed", "before": "...", "after": "..."}], '
    '"diff_annotations": [{"block_id": "B1", "summary": "noi dung thay doi", "legal_effect": "anh huong den quyen, nghia vu; khong ro thi unknown", "severity": "..."}]}\n'
)


def normalize_evidence(items: Column, most: int = 3) -> Column:
    none = F.array().cast(f"array<{EVIDENCE.simpleString()}>")
    tag = lambda x: F.coalesce(F.nullif(x["tag"], F.lit("")), F.lit("changed"))
    plain = F.transform(F.coalesce(items, none), lambda x: F.struct(tag(x).alias("tag"), normalize_ws(x["before"]).alias("before"), normalize_ws(x["after"]).alias("after")))
    said = F.slice(F.filter(plain, lambda x: (x["before"] != "") | (x["after"] != "")), 1, most)
    return F.transform(said, lambda x: F.struct(x["tag"].alias("tag"), cut(x["before"], 300).alias("before"), cut(x["after"], 300).alias("after")))


def ground_results(rows: DataFrame) -> DataFrame:
    """rows (status, conclusion, evidence, raw_evidence, v1_text, v2_text, …) with final
    status, conclusion and evidence, and grounded. raw_evidence stands in for missing evidence."""
    own = status_of_pair(F.col("v1_text"), F.col("v2_text"))
    r = rows.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(own))
    r = r.withColumn("evidence", normalize_evidence(F.col("evidence")))
    lacking = (F.col("status") != "unchanged") & (F.size("evidence") == 0)
    r = r.withColumn("evidence", F.when(lacking, normalize_evidence(F.col("raw_evidence"), 2)).otherwise(F.col("evidence")))
    given = F.nullif(normalize_ws(F.col("conclusion")), F.lit(""))
    default = F.when(F.col("status") == "added", DEFAULTS["added"]).when(F.col("status") == "removed", DEFAULTS["removed"]).otherwise(DEFAULTS["changed"])
    has = F.size("evidence") > 0
    r = r.withColumn("conclusion", F.when(F.col("status") == "unchanged", UNCHANGED).when(has, F.coalesce(given, default)).otherwise(UNGROUNDED))
    return r.withColumn("grounded", has | (F.col("status") == "unchanged"))


def _no_annotations() -> Column:
    return F.array().cast(f"array<{ANNOTATION.simpleString()}>")


def _rule_based(rows: DataFrame, conclusion: Column, reason: Column, model: Column) -> DataFrame:
    same = same_text(F.col("v1_text"), F.col("v2_text"))
    r = rows.withColumn("status", F.lit(None).cast("string")).withColumn("evidence", F.col("raw_evidence")).withColumn("conclusion", conclusion)
    r = ground_results(r).withColumn("diff_annotations", _no_annotations()).withColumn("llm_used", F.lit(False))
    return r.withColumn("fallback_reason", F.when(same, "texts_equal").otherwise(reason)).withColumn("llm_model", F.when(~same, model))


def compare_rule_based(pairs: DataFrame) -> DataFrame:
    """Results of pairs (pair_id, seq, v1_text, v2_text, …) without a model."""
    return _rule_based(with_diffs(pairs), F.lit(NO_MODEL), F.lit(NO_MODEL_REASON), F.lit(None).cast("string")).drop("raw_evidence")


def prompt_rows(pairs: DataFrame, max_blocks: int = 8) -> DataFrame:
    """pair_id, seq, prompt for each article that differs (pair_id, seq, article_number, article_title, v1_text, v2_text, diff_blocks)."""
    b = F.transform(
        F.slice("diff_blocks", 1, max_blocks),
        lambda x: F.struct(x["block_id"].alias("block_id"), x["tag"].alias("tag"), x["v1_lines"].alias("v1_lines"), x["v2_lines"].alias("v2_lines"), shorten(x["before"], 600).alias("before"), shorten(x["after"], 600).alias("after")),
    )
    shown = lambda c: F.coalesce(F.nullif(normalize_ws(F.col(c)), F.lit("")), F.lit("(khong co)"))
    text = F.concat(
        F.lit(PROMPT), F.lit("\narticle_number: "), "article_number", F.lit("\narticle_title: "), "article_title",
        F.lit("\n\nDieu v1:\n"), shown("v1_text"), F.lit("\n\nDieu v2:\n"), shown("v2_text"), F.lit("\n\nDIFF_BLOCKS:\n"), F.to_json(b),
    )
    return pairs.where(F.size("diff_blocks") > 0).select("pair_id", "seq", text.alias("prompt"))


def annotate_blocks(annotations: Column, blocks: Column, most: int = 8) -> Column:
    """Annotations whose block exists and that say something, with the block's tag and lines."""
    of = lambda a: F.get(F.filter(blocks, lambda b: b["block_id"] == strip(F.coalesce(a["block_id"], F.lit("")))), 0)
    severity = lambda a: strip(F.lower(F.coalesce(F.nullif(a["severity"], F.lit("")), F.lit("unknown"))))
    full = F.transform(
        annotations,
        lambda a: F.struct(
            of(a)["block_id"].alias("block_id"), of(a)["tag"].alias("tag"), of(a)["v1_lines"].alias("v1_lines"), of(a)["v2_lines"].alias("v2_lines"),
            shorten(a["summary"], 300).alias("summary"), shorten(a["legal_effect"], 400).alias("legal_effect"),
            F.when(severity(a).isin(*SEVERITIES), severity(a)).otherwise("unknown").alias("severity"),
        ),
    )
    says = F.filter(full, lambda a: a["block_id"].isNotNull() & ((a["summary"] != "") | (a["legal_effect"] != "")))
    return F.coalesce(F.slice(says, 1, most), _no_annotations())


def _items(v: Column, path: str, fields: tuple[str, ...]) -> Column:
    """A list of objects in a variant as structs of strings; items that aren't objects are left out."""
    items = F.try_variant_get(v, path, "array<variant>")
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.transform(objects, lambda x: F.struct(*[F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in fields]))


def apply_responses(pairs: DataFrame, responses: DataFrame, model: str = "model") -> DataFrame:
    """Results of pairs with a model's answers (pair_id, seq, raw_response). An answer that is
    missing, no JSON object or empty leads to the rule-based result."""
    d = pairs.join(responses, ["pair_id", "seq"], "left")  # differences would only be more to shuffle
    same = same_text(F.col("v1_text"), F.col("v2_text"))
    d = d.withColumn("_v", F.when(~same, first_json_object(F.col("raw_response"))))
    kind = F.schema_of_variant("_v")
    d = with_diffs(d.withColumn("_good", F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))))
    by = lambda good, bad: F.when(F.col("_good"), good).otherwise(bad)
    none = F.lit(None).cast("string")
    r = d.withColumn("status", by(F.try_variant_get("_v", "$.status", "string"), none))
    r = r.withColumn("evidence", by(_items(F.col("_v"), "$.evidence", ("tag", "before", "after")), F.col("raw_evidence")))
    r = ground_results(r.withColumn("conclusion", by(F.try_variant_get("_v", "$.conclusion", "string"), F.lit(BAD_RESPONSE))))
    notes = _items(F.col("_v"), "$.diff_annotations", ("block_id", "summary", "legal_effect", "severity"))
    r = r.withColumn("diff_annotations", by(annotate_blocks(notes, F.col("diff_blocks")), _no_annotations())).withColumn("llm_used", F.col("_good"))
    r = r.withColumn("fallback_reason", by(none, F.when(same, "texts_equal").otherwise(BAD_REASON))).withColumn("llm_model", F.when(~same, F.lit(model)))
    return r.drop("raw_evidence", "raw_response", "_v", "_good")
