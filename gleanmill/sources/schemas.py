"""Declared schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
STRINGS, INTS = T.ArrayType(S), T.ArrayType(I)


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


TICKET = fields(ticket_id=S, source_dataset=S, created_at=T.TimestampType(), ticket_type=S, priority=S, queue=S, business_type=S, subject=S, description=S, resolution=S, tags=STRINGS, status=S, raw_text=S)
LOG = fields(log_id=S, source_dataset=S, timestamp=T.TimestampType(), system=S, severity=S, component=S, message=S, is_anomaly=B, template=S, raw_log=S)
PAGE_BLOCK = fields(block_id=S, page_num=I, bbox=T.ArrayType(D), text=S, raw_text=S, block_type=S, font_size=D, is_heading=B, reading_order=I)
OFFICE_DOCUMENT = fields(doc_id=S, split=S, document_type=S, title=S, publisher=S, source_archive=S, source_member=S, page_count=I, file_size=L, text_layer_pages=I, is_valid=B, error=S)
QUESTION = fields(question_id=S, question=S, reference_answer=S, gold_doc_ids=STRINGS, gold_pages=INTS, evidence_text=S, question_type=S, lexical_overlap=D, hard_negative_doc_ids=STRINGS, review_status=S, source_type=S)
CHUNK_METADATA = fields(parent_doc_id=S, page_start=I, page_end=I, section_path=S, chunk_index=L, chunking_strategy=S)
CHUNK = fields(doc_id=S, source_type=S, title=S, content=S, embedding_text=S, metadata=CHUNK_METADATA)
DOCUMENT = fields(doc_id=S, source_type=S, title=S, content=S, embedding_text=S, metadata=fields(split=S, document_type=S, publisher=S, page_count=I, text_layer_pages=I, source_archive=S, source_member=S, parse_error=S))
SEARCH_RESULT = fields(query_id=S, doc_id=S, score=D, rank=L, title=S, content=S, source_scores=T.MapType(S, D))
CHECK = fields(name=S, status=S, observed=S, expected=S, details=S)
PAPER = fields(doc_id=S, source_path=S, zip_entry=S, relative_path=S, file_name=S, file_type=S, size_bytes=L, research_field=S, paper_topic=S, publication_year=S, parse_status=S)
ORACLE_ELEMENT = fields(doc_id=S, page_num=I, class_name=S, plain_text=S, visual_description=S, document_description=S)
