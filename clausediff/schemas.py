"""Declared schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DIEM = _struct(diem_number=_S, diem_key=_S, text=_S)
TIEU_MUC = _struct(tieu_muc_number=_S, title=_S, text=_S)
KHOAN = _struct(khoan_number=_S, title=_S, text=_S, diem_items=T.ArrayType(DIEM), tieu_muc_items=T.ArrayType(TIEU_MUC))
PARAGRAPHS = _struct(
    doc_id=_S, version=_S, idx=_I, text=_S, display_text=_S, style_name=_S, style_id=_S, heading_level=_I, num_id=_I, ilvl=_I,
    numbering_label=_S, numbering_path=T.ArrayType(_S),
)
STYLES = _struct(doc_id=_S, version=_S, style_id=_S, style_name=_S, based_on=_S, num_id=_I, ilvl=_I)
NUM_LEVELS = _struct(doc_id=_S, version=_S, num_id=_I, level=_I, start=_I, num_fmt=_S, lvl_text=_S)
CHUNKS = _struct(
    chunk_id=_S, doc_id=_S, version=_S, chunk_idx=_I, chunk_type=_S, chuong_so=_S, muc_so=_S, clause_id=_S, article_number=_S, article_title=_S,
    khoan_count=_I, diem_count=_I, tieu_muc_count=_I, khoan_items=T.ArrayType(KHOAN), text=_S, char_len=_I, created_at=T.TimestampType(),
)
#: Chunks as they are exported: without chunk_type and clause_id.
CHUNKS_JSONL = T.StructType([f for f in CHUNKS.fields if f.name not in ("chunk_type", "clause_id")])
INDEX_METADATA = ("doc_id", "version", "chuong_so", "muc_so", "article_number", "article_title", "khoan_count", "diem_count", "tieu_muc_count")
EVIDENCE = _struct(tag=_S, before=_S, after=_S)
DIFF_BLOCK = _struct(block_id=_S, tag=_S, v1_lines=T.ArrayType(_I), v2_lines=T.ArrayType(_I), before=_S, after=_S)
ANNOTATION = _struct(block_id=_S, tag=_S, v1_lines=T.ArrayType(_I), v2_lines=T.ArrayType(_I), summary=_S, legal_effect=_S, severity=_S)
DIFF_ROW = _struct(op=_S, block_id=_S, v1_no=_I, v2_no=_I, v1_text=_S, v2_text=_S)
RESPONSE = "struct<status:string,conclusion:string,evidence:variant,diff_annotations:variant>"
