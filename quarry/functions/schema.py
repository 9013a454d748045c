"""Closed schemas as columns: what keeps a row from a schema, by the path of each broken part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "string": (T.StringType,), "integer": (T.LongType, T.IntegerType, T.ShortType, T.ByteType), "boolean": (T.BooleanType,), "array": (T.ArrayType,), "object": (T.StructType,),
    "number": (T.DoubleType, T.FloatType, T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType), "null": (T.NullType,),
}
KNOWN = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems"}


def broken(schema: dict, value: Column, kind: T.DataType, path: Column | str = "$") -> Column:
    """array<string>: "path: rule" of everything in value, of the given type, that the schema does not let through.

    schema: of JSON schema's words those in KNOWN (another one is an error). A null stands for an absent field: it breaks
    `required` of its object, `type` where null is not among the types and it is no field, and nothing else. Fields
    that a closed object does not name, and types that cannot fit, are told for each row that has a value there.
    """
    if strange := set(schema) - KNOWN:
        raise ValueError(f"the schema's {sorted(strange)} are not known")
    at = F.lit(path) if isinstance(path, str) else path
    types = schema.get("type", list(KINDS))
    types = [types] if isinstance(types, str) else types
    told = lambda test, rule: F.when(test, F.concat(at, F.lit(f": {rule}")))
    none = F.array().cast("array<string>")
    if not isinstance(kind, T.NullType) and not any(isinstance(kind, KINDS[t]) for t in types):
        return F.when(value.isNotNull(), F.array(F.concat(at, F.lit(f": is no {' or '.join(types)}")))).otherwise(none)
    rules = []
    if "enum" in schema:
        rules.append(told(~value.isin(*[x for x in schema["enum"] if x is not None]), "is none of the allowed values"))
    if "const" in schema:
        rules.append(told(value != F.lit(schema["const"]), "is another value"))
    if isinstance(kind, T.StringType):
        if "pattern" in schema:
            rules.append(told(~value.rlike(schema["pattern"]), "does not match"))
        if "minLength" in schema:
            rules.append(told(F.length(value) < schema["minLength"], "is too short"))
        if "maxLength" in schema:
            rules.append(told(F.length(value) > schema["maxLength"], "is too long"))
    if isinstance(kind, KINDS["number"]):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            rules.append(told(F.isnan(value) | (F.abs(value) == float("inf")), "is no finite number"))
        if "minimum" in schema:
            rules.append(told(value < schema["minimum"], "is too small"))
        if "maximum" in schema:
            rules.append(told(value > schema["maximum"], "is too large"))
    inner = []
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            rules.append(told(F.size(value) < schema["minItems"], "has too few items"))
        if "maxItems" in schema:
            rules.append(told(F.size(value) > schema["maxItems"], "has too many items"))
        if "items" in schema:
            item, of = schema["items"], kind.elementType
            known = item.get("type", list(KINDS))
            may = "null" in ([known] if isinstance(known, str) else known)

            def one(x: Column, i: Column) -> Column:
                name = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
                lost = F.when(x.isNull(), F.array(F.concat(name, F.lit(": is null"))))
                own = broken(item, x, of, name)
                return own if may else F.coalesce(lost, own)

            inner.append(F.flatten(F.transform(value, one)))
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        parts = schema.get("properties", {})
        for name in schema.get("required", []):
            rules.append(told(value[name].isNull() if name in fields else F.lit(True), f"lacks {name}"))
        for name, of in fields.items():
            if name in parts:
                inner.append(broken(parts[name], value[name], of, F.concat(at, F.lit(f".{name}"))))
            elif schema.get("additionalProperties", True) is False:
                rules.append(told(value[name].isNotNull(), f"{name} is not in the schema"))
    own = F.array_compact(F.array(*rules)) if rules else none
    whole = F.concat(own, *[F.coalesce(x, none) for x in inner]) if inner else own
    return F.when(value.isNotNull(), whole).otherwise(none)


# What a chunk and the result of a review must look like.
CHUNK = {
    "type": "object", "additionalProperties": False, "required": ["chunk_id", "source_id", "source_title", "source_url", "retrieved_at", "text", "content_sha256", "char_start", "review_status"],
    "properties": {
        **{c: {"type": "string", "minLength": 1} for c in ("chunk_id", "source_id", "source_title", "source_url", "retrieved_at")},
        "text": {"type": "string", "minLength": 1, "maxLength": 1200}, "content_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}\\z"}, "char_start": {"type": "integer", "minimum": 0},
        "review_status": {"enum": ["pending", "reviewed", "fictional", "source_verified"]},
        **{c: {"type": ["string", "null"]} for c in ("section", "language", "jurisdiction", "source_kind", "source_sha256", "instrument_id", "celex", "publication_date", "document_version", "version_notice")},
        "schema_version": {"type": "integer"}, "page": {"type": ["integer", "null"]},
    },
}
QUOTE = {
    "type": "object", "required": ["source_id", "source_title", "source_url", "chunk_id", "text", "content_sha256"], "additionalProperties": False,
    "properties": {
        **{c: {"type": "string", "minLength": 1} for c in ("source_id", "source_title", "source_url", "retrieved_at", "chunk_id", "text")},
        "content_sha256": {"type": "string", "pattern": "^[0-9a-f]{64}\\z"}, "char_start": {"type": "integer", "minimum": 0}, "char_end": {"type": "integer", "minimum": 1},
        "place": {"type": "integer", "minimum": 1}, "truncated": {"type": "boolean"},
    },
}
RESULT = {
    "type": "object", "required": ["query", "answer_status", "evidence", "review_candidates", "confidence"], "additionalProperties": False,
    "properties": {
        "query_id": {"type": "integer"}, "query": {"type": "string", "minLength": 1, "maxLength": 1000}, "reason": {"enum": ["english_required", "version_review_required"]},
        "answer_status": {"enum": ["evidence_found", "insufficient_evidence"]}, "confidence": {"enum": ["unrated", "none"]}, "evidence": {"type": "array", "items": QUOTE},
        "review_candidates": {"type": "array", "items": {"type": "object", "required": ["source_id", "source_title", "source_url"]}},
    },
}
