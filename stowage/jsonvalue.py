"""JSON values as a document type holds them: exact numbers, last duplicate key wins, ordered keys."""

from __future__ import annotations

import functools
import json
import re
from decimal import Decimal, InvalidOperation
from typing import Any


class JsonError(ValueError):
    pass


_ARRAY_STEP = re.compile(r"\s*[+-]?\d+")
_BROKEN = re.compile("[\x00\ud800-\udfff]")
MISSING = object()


def _number(text: str) -> Decimal:
    if len(text) < 16_000 and "e" not in text and "E" not in text:
        return Decimal(text)  # too short to be out of range
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise JsonError(f"number {text[:40]} is out of range") from None
    if value and (value.adjusted() > 131_071 or -value.as_tuple().exponent > 16_383):
        raise JsonError(f"number {text[:40]} is out of range")
    return value


def _constant(text: str):
    raise JsonError(f"invalid input syntax for type json: token {text!r} is invalid")


_decoder = json.JSONDecoder(parse_float=_number, parse_int=_number, parse_constant=_constant)  # the last of equal keys wins


def parse(text: str) -> Any:
    """Python values with Decimal numbers. Raises JsonError with one line of explanation."""
    try:
        value = _decoder.decode(text)
    except JsonError:
        raise
    except RecursionError:
        raise JsonError("json is nested too deeply") from None
    except ValueError as error:
        raise JsonError(f"invalid input syntax for type json: {error}") from None
    if "\\u" in text or _BROKEN.search(text):
        _refuse_broken(value)
    return value


def _refuse_broken(value: Any) -> None:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str) and _BROKEN.search(x):
            raise JsonError("unsupported Unicode escape sequence")
        if isinstance(x, dict):
            stack += [*x.keys(), *x.values()]
        elif isinstance(x, list):
            stack += x


def number_text(value: Decimal) -> str:
    text = format(value, "f")
    return text.lstrip("-") if not value else text


string_text = json.encoder.encode_basestring  # quotes, backslashes and control characters escaped


def key_order(key: str) -> tuple[int, bytes]:
    data = key.encode()
    return len(data), data


def _ordered(keys: tuple[str, ...]) -> list[tuple[str, str]]:
    """Keys in their order, each with the text that precedes its value."""
    return [(k, string_text(k) + ": ") for k in sorted(keys, key=key_order)]


_ordered_before = functools.lru_cache(256)(_ordered)


def _members(value: dict) -> list[tuple[str, str]]:
    """Documents of a column share few shapes; those of bounded size are kept."""
    keys = tuple(value)
    return (_ordered_before if len(keys) <= 32 and len("".join(keys)) <= 1024 else _ordered)(keys)


def dump(value: Any) -> str:
    """The canonical text: keys by length and bytes, numbers with their scale, ', ' and ': '."""
    kind = type(value)
    if kind is str:
        return string_text(value)
    if kind is Decimal:
        return number_text(value)
    if kind is dict:
        return "{" + ", ".join([start + dump(value[k]) for k, start in _members(value)]) + "}"
    if kind is list:
        return "[" + ", ".join(map(dump, value)) + "]"
    return "null" if value is None else "true" if value else "false"


def canonical(text: str) -> str:
    return dump(parse(text))


def _plain_number(value: Decimal) -> str:
    text = number_text(value)
    return (text.rstrip("0").rstrip(".") or "0") if "." in text else text


def equality_key(value: Any) -> str:
    """Text that is equal for equal values, whatever their key order and the scale of their numbers."""
    if isinstance(value, Decimal):
        return _plain_number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(equality_key, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{string_text(k)}:{equality_key(value[k])}" for k in sorted(value, key=key_order)) + "}"
    return dump(value)


def as_text(value: Any) -> str | None:
    """What ->> gives: the string itself, no value for null, canonical text for the rest."""
    if value is MISSING or value is None:
        return None
    return value if isinstance(value, str) else dump(value)


def as_json(value: Any) -> str | None:
    return None if value is MISSING else dump(value)


def field(value: Any, key: str) -> Any:
    return value.get(key, MISSING) if isinstance(value, dict) else MISSING


def element(value: Any, index: int) -> Any:
    return value[index] if isinstance(value, list) and -len(value) <= index < len(value) else MISSING


def at_path(value: Any, path: list[str | None]) -> Any:
    for step in path:
        if step is None:
            return MISSING
        if isinstance(value, dict):
            value = field(value, step)
        elif isinstance(value, list) and _ARRAY_STEP.fullmatch(step):
            value = element(value, int(step))
        else:
            return MISSING
    return value


def has(value: Any, key: str) -> bool:
    if isinstance(value, dict):
        return key in value
    if isinstance(value, list):
        return any(isinstance(x, str) and x == key for x in value)
    return isinstance(value, str) and value == key


def _same(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b


def contains(a: Any, b: Any, top: bool = True) -> bool:
    """Whether a holds all of b: objects by key, arrays by some element; at the top an array holds a
    scalar element too."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(x, y, False) for x in a) for y in b)
    if top and isinstance(a, list):
        return any(_same(x, b) for x in a)
    return _same(a, b)
