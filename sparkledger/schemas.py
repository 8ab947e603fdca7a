"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


STRINGS = ArrayType(StringType())

#: A test method as a scanner finds it. The source text is kept apart, once for each class.
METHOD = _struct(fqcn=StringType(), method=StringType(), begin_line=IntegerType(), end_line=IntegerType(), loc=IntegerType(), tags=STRINGS, display_name=StringType(), file_path=StringType(), file_stem=StringType())

#: A persisted row of an inventory. Null ai_tags: no model was asked; empty: it suggested none.
SCAN_RECORD = _struct(
    fqcn=StringType(), method=StringType(), loc=IntegerType(), tags=STRINGS, display_name=StringType(), content_hash=StringType(),
    ai_security_relevant=BooleanType(), ai_display_name=StringType(), ai_tags=STRINGS, ai_reason=StringType(),
    ai_confidence=DoubleType(), ai_interaction_score=DoubleType(), tag_ai_drift=StringType(),
)

SUGGESTION = _struct(methodName=StringType(), securityRelevant=BooleanType(), displayName=StringType(), tags=STRINGS, reason=StringType(), confidence=DoubleType(), interactionScore=DoubleType())
VERDICT = _struct(candidateIndex=IntegerType(), credibilityScore=DoubleType(), endpoint=StringType(), rationale=StringType())
CLASS_SUGGESTION = _struct(className=StringType(), classSecurityRelevant=BooleanType(), classTags=STRINGS, classReason=StringType(), methods=ArrayType(SUGGESTION), secrets=ArrayType(VERDICT))
CACHE_ENTRY = _struct(contentHash=StringType(), promptSignature=StringType(), suggestion=CLASS_SUGGESTION)
OVERRIDE = _struct(pos=IntegerType(), fqcn=StringType(), method=StringType(), security_relevant=BooleanType(), tags=STRINGS, display_name=StringType(), reason=StringType(), note=StringType())
MAPPING = _struct(tag=StringType(), tag_pos=IntegerType(), pos=IntegerType(), control_id=StringType(), chapter=StringType(), chapter_title=StringType())
RULE = _struct(id=StringType(), category=StringType(), anchors=STRINGS, pattern=StringType(), entropy_min=DoubleType(), description=StringType(), provenance=StringType())
FINDING = _struct(
    file=StringType(), fqcn=StringType(), method=StringType(), begin_line=IntegerType(), begin_column=IntegerType(), end_line=IntegerType(), rule_id=StringType(),
    category=StringType(), detector_id=StringType(), snippet_masked=StringType(), credibility_score=DoubleType(), endpoint=StringType(), rationale=StringType(),
)
ARCHIVE = _struct(contentHash=StringType(), fqcn=StringType(), promptTokens=LongType(), responseTokens=LongType(), prompt=StringType(), response=StringType(), modelId=StringType(), timestampUtc=StringType())
AUDIT = (
    "fqcn", "method", "loc", "applied_tags", "applied_display_name", "ai_security_relevant", "ai_display_name", "ai_tags", "ai_reason",
    "ai_confidence", "ai_interaction_score", "tag_ai_drift", "tags_added", "tags_removed", "saved_at",
)
