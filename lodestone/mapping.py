"""Declared schemas of indexes: typed fields, checked when an index is created and when a field is added."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lodestone.errors import ParseError, ValidationError

TYPES = {"Text": StringType(), "Keyword": StringType(), "Bool": BooleanType(), "Number": DoubleType()}
INDEXED = ("Text", "Keyword")
_NAME_RULE = "a name is made of letters, digits, - and _, one at least"


def valid_name(name: Any) -> bool:
    """Non-empty; letters and digits of any script, ``-`` and ``_``."""
    return isinstance(name, str) and re.fullmatch(r"[^\W_]*(?:[-_]+[^\W_]*)*", name) is not None and name != ""


def check_name(name: Any) -> str:
    if not valid_name(name):
        raise ValidationError(f"{_NAME_RULE}: {name!r}")
    return name


@dataclass(frozen=True)
class Field:
    name: str
    s_type: str
    required: bool = True

    @staticmethod
    def from_json(value: Any) -> Field:
        if not isinstance(value, dict):
            raise ParseError("a field must be an object")
        name, kind, required = value.get("fieldName"), value.get("sType"), value.get("required", True)
        if not valid_name(name):
            raise ParseError(f"{_NAME_RULE}: {name!r}")
        if kind not in TYPES:
            raise ParseError(f"sType must be one of {', '.join(TYPES)}: {kind!r}")
        if not isinstance(required, bool):
            raise ParseError("required must be a boolean")
        return Field(name, kind, required)

    def to_json(self) -> dict:
        return {"fieldName": self.name, "sType": self.s_type, "required": self.required}


@dataclass(frozen=True)
class Mapping:
    """At least one field, in the order of declaration (an added field comes first)."""

    fields: tuple[Field, ...]

    @staticmethod
    def of(value: Any) -> Mapping:
        """From a mapping, its JSON form as text or objects, or (name, type[, required]) tuples."""
        if isinstance(value, Mapping):
            return value
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError as e:
                raise ParseError(f"the mapping is no JSON: {e}") from e
        if isinstance(value, dict):
            fields = value.get("fields")
            if not isinstance(fields, list) or not fields:
                raise ParseError("fields must be a list that is not empty")
            return Mapping(tuple(Field.from_json(f) for f in fields))
        if isinstance(value, Iterable):
            fields = tuple(f if isinstance(f, Field) else Field.from_json(dict(zip(("fieldName", "sType", "required"), f))) for f in value)
            if fields:
                return Mapping(fields)
        raise ParseError("a mapping needs at least one field")

    def to_json(self) -> str:
        return json.dumps({"fields": [f.to_json() for f in self.fields]}, ensure_ascii=False)

    @property
    def indexed(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.s_type in INDEXED)

    def schema(self) -> StructType:
        """Of the document column; the declared type is kept in the metadata."""
        return StructType([StructField(f.name, TYPES[f.s_type], not f.required, {"sType": f.s_type}) for f in self.fields])

    def with_field(self, field: Field | dict | tuple) -> Mapping:
        new = Mapping.of([field] if not isinstance(field, dict) else {"fields": [field]}).fields[0]
        changed = Mapping((new, *self.fields))
        changed.validate()
        return changed

    def problems(self) -> list[str]:
        twice = sorted(n for n, k in Counter(f.name for f in self.fields).items() if k > 1)
        return [f"fields declared more than once: {', '.join(twice)}"] if twice else []

    def validate(self, name: str | None = None, existing: Iterable[str] = ()) -> None:
        """Raises one error that tells everything that is wrong."""
        found = self.problems()
        if name is not None and name in set(existing):
            found.append(f"there is an index {name} already")
        if found:
            raise ValidationError(" - ".join(found))
