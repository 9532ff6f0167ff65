"""Line and character differences of two texts. difflib decides the blocks, in batches of
the rows that differ; all else stays in Spark."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausediff.functions.text import same_text
from clausediff.schemas import DIFF_BLOCK, DIFF_ROW, EVIDENCE
from clausediff.sources.lines import LINE_END

_BLOCK_TAGS = {"delete": "removed", "insert": "added", "replace": "changed"}
_EVIDENCE_TAGS = {"delete": "delete", "insert": "insert", "replace": "changed"}


def _ws(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def _short(text: str | None, most: int) -> str:
    t = _ws(text)
    return t if len(t) <= most else t[: most - 3].rstrip() + "..."


def _ops(a, b):
    """difflib's opcodes. Where one side goes on after the other has ended they are known without
    its quadratic search: a run of the shorter side's items stands at the same place in the longer
    one, and is found there first, so the longest match starts at 0 and takes in all the shorter side."""
    n, m = len(a), len(b)
    if 0 < n < m and b[:n] == a:
        return [("equal", 0, n, 0, n), ("insert", n, n, n, m)]
    if 0 < m < n and a[:m] == b:
        return [("equal", 0, m, 0, m), ("delete", m, n, m, m)]
    return difflib.SequenceMatcher(None, a, b).get_opcodes()


def line_blocks(before: str | None, after: str | None, most: int = 900) -> list[dict]:
    a, b = (before or "").splitlines(), (after or "").splitlines()
    changed = [op for op in _ops(a, b) if op[0] != "equal"]
    return [
        {
            "block_id": f"B{n}", "tag": _BLOCK_TAGS[tag], "v1_lines": list(range(i + 1, j + 1)), "v2_lines": list(range(k + 1, l + 1)),
            "before": _short("\n".join(a[i:j]), most), "after": _short("\n".join(b[k:l]), most),
        }
        for n, (tag, i, j, k, l) in enumerate(changed, 1)
    ]


def evidence_items(before: str | None, after: str | None, most: int = 3, window: int = 120) -> list[dict]:
    a, b = _ws(before), _ws(after)
    if bool(a) != bool(b):
        return [{"tag": "removed" if a else "added", "before": _short(a, 300), "after": _short(b, 300)}]
    around = lambda t, i, j: _short(t[max(0, i - window) : j + window], 300)
    changed = [op for op in _ops(a, b) if op[0] != "equal"][:most]
    return [{"tag": _EVIDENCE_TAGS[tag], "before": around(a, i, j), "after": around(b, k, l)} for tag, i, j, k, l in changed]


def side_by_side(before: str | None, after: str | None) -> list[dict]:
    """Rows of aligned lines; the longer side of a replacement runs on beside empty ones."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    rows, block = [], 0
    for tag, i, j, k, l in _ops(a, b):
        block += tag != "equal"
        for x in range(max(j - i, l - k)):
            left, right = (i + x if i + x < j else None), (k + x if k + x < l else None)
            rows.append({"op": tag, "block_id": None if tag == "equal" else f"B{block}", "v1_no": None if left is None else left + 1, "v2_no": None if right is None else right + 1, "v1_text": "" if left is None else a[left], "v2_text": "" if right is None else b[right]})
    return rows


def _udf(function, item: T.StructType):
    @F.pandas_udf(T.ArrayType(item))
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([function(a, b) for a, b in zip(before, after, strict=True)])

    return run


def differs(before: Column, after: Column) -> Column:
    return ~same_text(before, after)


def with_diffs(pairs: DataFrame, max_items: int = 2) -> DataFrame:
    """pairs (pair_id, seq, v1_text, v2_text, …) with diff_blocks and raw_evidence; empty
    where the texts agree, whose texts aren't sent to Python."""
    schema = T.StructType([T.StructField("diff_blocks", T.ArrayType(DIFF_BLOCK)), T.StructField("raw_evidence", T.ArrayType(EVIDENCE))])

    @F.pandas_udf(schema)
    def both(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        texts = list(zip(before, after, strict=True))
        return pd.DataFrame({"diff_blocks": [line_blocks(a, b) for a, b in texts], "raw_evidence": [evidence_items(a, b, max_items) for a, b in texts]})

    d = differs(F.col("v1_text"), F.col("v2_text"))
    out = pairs.withColumn("_d", d)
    out = out.withColumn("_x", both(F.when(F.col("_d"), F.col("v1_text")), F.when(F.col("_d"), F.col("v2_text"))))  # nulls give empty lists
    return out.select("*", "_x.*").drop("_x", "_d")


def diff_blocks(pairs: DataFrame) -> DataFrame:
    changed = pairs.where(differs(F.col("v1_text"), F.col("v2_text")))
    return changed.select("pair_id", "seq", F.inline(_udf(line_blocks, DIFF_BLOCK)("v1_text", "v2_text")))


def extract_evidence(pairs: DataFrame, max_items: int = 3) -> DataFrame:
    changed = pairs.where(differs(F.col("v1_text"), F.col("v2_text")))
    run = _udf(lambda a, b: evidence_items(a, b, max_items), EVIDENCE)
    return changed.select("pair_id", "seq", F.posexplode(run("v1_text", "v2_text")).alias("item", "e")).select("pair_id", "seq", "item", "e.*")


def _lines(text: Column) -> Column:
    """A text's lines as Python's splitlines() gives them."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_diff_rows(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, row, op, block_id, v1_no, v2_no, v1_text, v2_text: both texts side by side.
    Equal texts are laid out by Spark; only others go to Python."""
    run = _udf(side_by_side, DIFF_ROW)
    same = F.coalesce("v1_text", F.lit("")) == F.coalesce("v2_text", F.lit(""))
    none = F.lit(None).cast("string")
    equal = pairs.where(same).select("pair_id", "seq", F.posexplode(_lines(F.col("v1_text"))).alias("row", "line"))
    no = (F.col("row") + 1).cast("int")
    equal = equal.select("pair_id", "seq", "row", F.lit("equal").alias("op"), none.alias("block_id"), no.alias("v1_no"), no.alias("v2_no"), F.col("line").alias("v1_text"), F.col("line").alias("v2_text"))
    others = pairs.where(~same).select("pair_id", "seq", F.posexplode(run("v1_text", "v2_text")).alias("row", "d")).select("pair_id", "seq", "row", "d.*")
    return equal.unionByName(others)


def rebuilt_texts(rows: DataFrame) -> DataFrame:
    """pair_id, seq, blocks, v1_text, v2_text: both texts put together again from line_diff_rows(),
    in the order of their line numbers, with how many blocks they differ in. A text without lines is empty."""
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col(f"{n}_no").isNotNull(), F.struct(f"{n}_no", f"{n}_text"))))
    text = lambda n: F.array_join(F.transform(n, lambda x: x[f"{n}_text"]), "\n").alias(f"{n}_text")
    found = rows.groupBy("pair_id", "seq").agg(F.count_distinct("block_id").alias("blocks"), side("v1").alias("v1"), side("v2").alias("v2"))
    return found.select("pair_id", "seq", "blocks", text("v1"), text("v2"))
