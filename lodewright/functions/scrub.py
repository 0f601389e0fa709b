"""Redaction of JSON of any shape: VARIANT values and JSON text, by the rules for texts and for field names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COUNTERS, REDACTIONS, SECRET_FIELD, SECRET_NAMES

#: How deep containers are followed, and what stands for those below, and for a secret.
DEPTH, TOO_DEEP, SECRET = 50, "[REDACTED_MAX_DEPTH]", "[REDACTED_SECRET]"

_RULES = [(re.compile(pattern), to.replace("$1", r"\1")) for _, pattern, to in REDACTIONS]
_ASSIGNED = re.compile(rf"(?i)\b({SECRET_NAMES})\s*+[:=]\s*+(?!\[REDACTED_)[^\s\"']+")
_FIELD = re.compile(SECRET_FIELD)


def scrub_text(text: str) -> str:
    for pattern, to in _RULES:
        text = pattern.sub(to, text)
    return _ASSIGNED.sub(r"\1=" + SECRET, text)


def _secret(key: str, value) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return key.lower() not in COUNTERS and not (number and "token" in key.lower()) and bool(_FIELD.search(key))


def scrub(value, depth: int = 0):
    """A JSON value with its texts redacted, fields of secret names replaced whole, and what is DEPTH containers deep replaced by a mark."""
    if isinstance(value, str):
        return scrub_text(value)
    if depth >= DEPTH:
        return TOO_DEEP
    if isinstance(value, dict):
        return {k: SECRET if _secret(k, v) else scrub(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub(v, depth + 1) for v in value]
    return value


def scrub_json(text: str) -> str:
    """A JSON text with its value scrubbed, numbers in their shortest form; a text that is no JSON, holds numbers beyond a double, or is nested
    beyond what a parser follows, is redacted as a text."""
    try:
        return json.dumps(scrub(json.loads(text)), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return scrub_text(text)


def scrubbed_json(c: Column) -> Column:
    """``scrub_json`` of every text of a column; null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(scrub_json, na_action="ignore")

    return run(c)


def scrubbed(c: Column) -> Column:
    """A VARIANT column scrubbed, as VARIANT; null stays null."""
    return F.try_parse_json(scrubbed_json(F.to_json(c)))
