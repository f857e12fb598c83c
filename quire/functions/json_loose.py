"""JSON out of a model's answer, however it is wrapped."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
#: Inside a string: an escaped character, a quotation mark that ends it (as punctuation or the end follows), another one.
INSIDE = re.compile(r'(\\.)|(")(?=[ \t\r\n]*(?:[,:\]}]|\Z))|(")', re.DOTALL)


def mend_quotes(text: str) -> str:
    """``text`` with a backslash before quotation marks that stand inside a string."""
    out, at = [], 0
    while (begin := text.find('"', at)) >= 0:
        out.append(text[at : begin + 1])
        at = begin + 1
        for m in INSIDE.finditer(text, at):
            if m[1]:
                continue
            out += [text[at : m.start()], '"' if m[2] else '\\"']
            at = m.end()
            if m[2]:
                break
        else:
            break
    return "".join(out) + text[at:]


def _widest(text: str) -> Iterator[str]:
    """From the first opening bracket to the last closing one, for lists, then for objects."""
    for a, b in ("[]", "{}"):
        i, j = text.find(a), text.rfind(b)
        if 0 <= i < j:
            yield text[i : j + 1]


def _first(text: str) -> Any:
    """The first whole value that a bracket opens."""
    at = re.search(r"[\[{]", text)
    if not at:
        raise ValueError("no bracket")
    return json.JSONDecoder().raw_decode(text, at.start())[0]


def _attempts(text: str) -> Iterator[tuple[Callable[[str], Any], str]]:
    text = text.strip()
    yield json.loads, text
    fence = FENCE.search(text)
    if fence:
        text = fence[1].strip()
        yield json.loads, text
    yield from ((json.loads, part) for part in _widest(text))
    yield _first, text
    yield _first, mend_quotes(text)
    yield from ((json.loads, mend_quotes(part)) for part in (text, *_widest(text)))


def parse(text: str | None) -> Any:
    """The first reading that succeeds: plain, fenced, the widest list or object, the first whole value,
    then the same with quotation marks inside strings mended. None of them: ValueError."""
    for read, part in _attempts(text or ""):
        try:
            return read(part)
        except (ValueError, RecursionError):
            continue
    raise ValueError(f"no JSON in {(text or '')[:200]!r}")


def keyed(value: Any, key: str, default: Any = None) -> Any:
    """``value[key]`` of an object, the default where it lacks it; another non-empty value is itself."""
    if isinstance(value, dict):
        return value.get(key, default)
    return value if value else default


def usage_int(usage: Any, name: str) -> int:
    """A whole number of a usage record; 0 where it is missing or none."""
    try:
        return int((usage or {}).get(name) or 0)
    except (TypeError, ValueError, AttributeError):
        return 0


def reasoning_tokens(usage: Any) -> int:
    """The record's own number, else that of its details."""
    if not isinstance(usage, dict):
        return 0
    return usage_int(usage, "reasoning_tokens") if "reasoning_tokens" in usage else usage_int(usage.get("completion_tokens_details"), "reasoning_tokens")


def parsed(answer: Column, key: str | None = None) -> Column:
    """The answer as plain JSON text (the value of ``key``, where given); null where it holds none.

    Answers that are JSON already stay in the JVM; only the others go through Python.
    """

    @F.arrow_udf("string")
    def loose(answers: pa.Array) -> pa.Array:
        out = []
        for t in answers.to_pylist():
            try:
                v = parse(t) if t is not None else None
                v = keyed(v, key) if key else v
                out.append(None if v is None else json.dumps(v, ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    plain = F.try_parse_json(answer)
    read = F.to_json(plain) if key is None else None
    return loose(answer) if read is None else F.coalesce(read, loose(F.when(plain.isNull(), answer)))
