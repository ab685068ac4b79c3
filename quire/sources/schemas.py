"""JSON schemas of responses, read on the driver: a handful of small files."""

from __future__ import annotations

import json
from pathlib import Path

REQUIRED = {"transcription", "no_transcribable_text", "transcription_not_possible"}


def unwrapped(schema: dict, name: str = "TranscriptionSchema", strict: bool = True) -> tuple[str, dict, bool]:
    """Name, schema and strictness of a schema that stands alone or in {name, strict, schema}."""
    inner = schema.get("schema") if isinstance(schema, dict) else None
    if isinstance(inner, dict):
        return str(schema.get("name") or name), inner, bool(schema.get("strict", strict))
    return name, schema if isinstance(schema, dict) else {}, strict


def text_format(schema: dict) -> dict | None:
    """The format part of a request; null for an empty schema."""
    name, bare, strict = unwrapped(schema)
    return {"type": "json_schema", "name": name, "schema": bare, "strict": strict} if bare else None


def is_valid(schema: dict) -> bool:
    """An object with the properties that every response has (Q17)."""
    _, bare, _ = unwrapped(schema)
    properties = bare.get("properties")
    return bare.get("type") == "object" and isinstance(properties, dict) and properties.keys() >= REQUIRED


def schemas(folder: str) -> list[tuple[str, str]]:
    """``(name, path)`` of the valid schemas of a folder, by name without regard to case."""
    found = []
    for path in Path(folder).glob("*.json"):
        try:
            schema = json.loads(path.read_text(encoding="utf-8"))
        except ValueError:
            continue
        if isinstance(schema, dict) and is_valid(schema):
            name = schema.get("name")
            found.append((name.strip() if isinstance(name, str) and name.strip() else path.stem, str(path)))
    return sorted(found, key=lambda x: x[0].lower())
