"""JSON of model responses: bounded repair of missing closers, and a validator for the closed schemas the engine uses."""

from __future__ import annotations

import json
from typing import Any

MOST_BYTES, MOST_POSITIONS = 64 * 1024, 4096


def _distinct(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is there twice")
    return out


def _parse(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text, object_pairs_hook=_distinct)
    except ValueError:
        return False, None


def _outside(raw: str) -> tuple[list[int], str]:
    """Positions outside strings, and the closers that are open at the end (none where the text ends in a string or closes wrongly)."""
    places, open_, inside, k = [], [], False, 0
    sound = True
    while k < len(raw):
        c = raw[k]
        if inside:
            k += 2 if c == "\\" else 1
            inside = c != '"'
            continue
        places.append(k)
        if c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            sound = bool(open_) and open_.pop() == c and sound
        k += 1
    if inside:
        return places, ""
    return [*places, len(raw)], "".join(reversed(open_)) if sound else ""


def recover(raw: str) -> Any:
    """The value of a text that lacks one closer outside its strings, or at most two at its end.

    Raises where none or several readings exist, where a key is there twice, and where the text is over the limits, which are never cut to.
    """
    ok, value = _parse(raw)
    if ok:
        return value
    places, end = _outside(raw)
    if len(raw.encode()) > MOST_BYTES or len(places) > MOST_POSITIONS:
        raise ValueError("the text is too long to repair")
    tries = {raw[:i] + c + raw[i:] for i in places for c in "}]"} | ({raw + end} if 1 <= len(end) <= 2 else set())
    readings = {json.dumps(v, sort_keys=True): v for ok, v in map(_parse, tries) if ok}
    if len(readings) != 1:
        raise ValueError(f"{len(readings)} readings")
    return next(iter(readings.values()))


_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def problems(value: Any, schema: dict, path: str = "$") -> list[str]:
    """Where a value leaves the schema: type, enum, required, additionalProperties, maxItems."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def fits(k: str) -> bool:
        if k == "integer":
            return isinstance(value, int) and not isinstance(value, bool)
        if k == "number":
            return isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf")
        return isinstance(value, _KINDS[k])

    if kinds and not any(map(fits, kinds)):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = [f"{path}: not allowed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in value if k not in known]
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{path}.{k}")
    if isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{path}: too many items")
        for i, v in enumerate(value):
            out += problems(v, schema.get("items", {}), f"{path}[{i}]")
    return out
