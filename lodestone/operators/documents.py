"""JSON documents under a mapping: declared types are checked, not coerced.

``from_json`` would turn a number into a string where a string is declared; a VARIANT keeps what the JSON said.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.mapping import TYPES, Field, Mapping

# What the schema of a JSON value may be for a declared type, as a pattern.
_SHAPES = {"Text": "STRING", "Keyword": "STRING", "Bool": "BOOLEAN", "Number": r"BIGINT|DOUBLE|DECIMAL\(.*\)"}


def whole_object(text: Column) -> Column:
    """A text as VARIANT if it is one whole JSON object, else null.  Text after the object, repeated keys and anything that
    standard JSON does not know make it incomplete."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(alone & F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.try_parse_json(text))


def _value(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f'$["{name}"]', "variant")


def _error(variant: Column, field: Field) -> Column:
    value = _value(variant, field.name)
    missing = value.isNull() | F.is_variant_null(value)
    wrong = ~F.schema_of_variant(value).rlike(f"^(?:{_SHAPES[field.s_type]})$")
    lacking = F.lit(f'key "{field.name}" not found') if field.required else F.lit(None).cast("string")
    return F.when(missing, lacking).when(wrong, F.lit(f'key "{field.name}" is not of type {field.s_type}'))


def parse_documents(rows: DataFrame, mapping: Mapping, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``doc`` (a struct of the declared fields) and ``error`` (null if the document is accepted).

    Undeclared keys are dropped.  A required field must be there and not null; an optional one may be missing or null.
    The first error in the order of declaration is told; ``doc`` is null with an error.  A null or blank text, or one
    that is no JSON object, is an error.
    """
    variant = whole_object(F.col(column))
    parsed = rows.select(*keep, variant.alias("_variant"))
    v = F.col("_variant")
    error = F.when(v.isNull(), F.lit("the document is no JSON object"))
    error = reduce(lambda so_far, f: F.coalesce(so_far, _error(v, f)), mapping.fields, error)
    parsed = parsed.withColumn("error", error)
    values = [F.try_variant_get(v, f'$["{f.name}"]', TYPES[f.s_type].simpleString()).alias(f.name) for f in mapping.fields]
    return parsed.select(*keep, F.when(F.col("error").isNull(), F.struct(*values)).alias("doc"), "error")


class Undecided(Exception):
    """A text that the driver leaves to :func:`parse_documents`."""


def parse_document(text: str, mapping: Mapping) -> tuple[dict | None, str | None]:
    """``(doc, error)`` of one text, by the rules of :func:`parse_documents` but without a job; raises :class:`Undecided`
    for numbers and characters that the two might take differently."""

    def pairs(items: list) -> dict:
        found = dict(items)
        if len(found) != len(items):
            raise ValueError("a repeated key")
        return found

    def constant(name: str):
        raise ValueError(f"{name} is no JSON")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
        text.encode("utf-8")
    except (RecursionError, UnicodeEncodeError) as e:
        raise Undecided from e
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, "the document is no JSON object"
    if "\\u" in text or any(isinstance(v, (int, float)) and not abs(v) < 1e300 for v in value.values()):
        raise Undecided
    kinds = {"Text": str, "Keyword": str, "Bool": bool, "Number": (int, float)}
    doc = {}
    for f in mapping.fields:
        v = value.get(f.name)
        if v is None:
            if f.required:
                return None, f'key "{f.name}" not found'
        elif not isinstance(v, kinds[f.s_type]) or (f.s_type == "Number" and isinstance(v, bool)):
            return None, f'key "{f.name}" is not of type {f.s_type}'
        else:
            doc[f.name] = float(v) if f.s_type == "Number" else v
    return doc, None


def typed_documents(rows: DataFrame, mapping: Mapping, id_column: str | None = None) -> DataFrame:
    """``(doc_id, doc, error)`` from columns named as the fields; columns of another type are an error of the call, a
    null in a required field one of the row."""
    by_name = {f.name: f.dataType for f in rows.schema.fields}
    for f in mapping.fields:
        if f.required and f.name not in by_name:
            raise ValueError(f"no column for the required field {f.name}")
    errors = F.lit(None).cast("string")
    values = []
    for f in mapping.fields:
        value = F.col(f"`{f.name}`").cast(TYPES[f.s_type]) if f.name in by_name else F.lit(None).cast(TYPES[f.s_type])
        values.append(value.alias(f.name))
        if f.required:
            errors = F.coalesce(errors, F.when(value.isNull(), F.lit(f'key "{f.name}" not found')))
    doc_id = [F.col(id_column).cast("bigint").alias("doc_id")] if id_column else []
    return rows.select(*doc_id, F.struct(*values).alias("_doc"), errors.alias("error")).select(
        *(["doc_id"] if id_column else []), F.when(F.col("error").isNull(), F.col("_doc")).alias("doc"), "error"
    )


def result_json(results: DataFrame) -> DataFrame:
    """One JSON text per hit of ``results(id, score, doc)``; optional fields that are absent are left out."""
    return results.select(F.to_json(F.struct("id", "score", "doc")).alias("json"))
