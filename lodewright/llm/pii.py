"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a text and reports anchors: at-signs, ``://`` and ``mailto:`` schemes, a plus before a
digit, digits two places apart at most, and words that announce an identifier. Each anchor is expanded by a deterministic parser to
the span around it, and the span is validated. Parsers give just the leftmost non-overlapping matches that a scan of the whole text
would, and pass over a stretch of text a fixed number of times, however long it is: an email is read left and right of its at-sign,
whose two runs hold no other; numbers are read group by group, and a group starts a match at its first digit only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship

#: Kinds in the order of the output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = 4
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP_RUN, _IP_CHARS = re.compile(r"[0-9.]*"), frozenset(_DIGITS + ".")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD_RUN, _CARD, _CARD_CHARS = re.compile(r"[0-9 -]*"), re.compile(r"[0-9]([\x20-]?[0-9])+"), frozenset(_DIGITS + " -")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NOT_FIRST = frozenset("0123456789+.-")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"']+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
#: Characters after a cue in which an IBAN begins though the line has ended, and characters of an IBAN at most, spaces included.
REACH, IBAN_MOST = 47, 43
#: Words that announce an identifier, and the kind of what follows.
CUES = {
    "iban": "iban", "account": "account", "acct": "account", "a/c": "account", "routing": "account", "ssn": "account", "passport": "account",
    "token": "secret", "api_key": "secret", "apikey": "secret", "api key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
}
_ACCOUNT = re.compile(r"[\x20\t]{0,2}(?:no\.?|number|nr\.?|id)?[\x20\t]{0,2}[:#=]?[\x20\t]{0,2}(?=[A-Z0-9])", re.I | re.A)
_ACCOUNT_RUN, _FOUR = re.compile(r"[A-Z0-9-]*", re.I | re.A), re.compile(r"[0-9]{4}")
_SECRET = re.compile(r"[\x20\t]{0,2}[:=][\x20\t]{0,2}[\"']?([A-Za-z0-9_+/=.-]{16,})", re.A)

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in CUES.items():
            for form in {word, word.upper(), word.capitalize()}:
                a.add_word(form, (kind, len(form)))
        a.add_word("@", ("email", 1))
        a.add_word("://", ("url", 3))
        for d in _DIGITS:
            a.add_word("+" + d, ("phone", 2))
            for e in _DIGITS:
                a.add_word(d + "." + e, ("ip", 3))
                for between in ("", " ", "-"):
                    a.add_word(d + between + e, ("card", 2 + len(between)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _left(text: str, at: int, chars: frozenset, least: int = 0) -> int:
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


class _Accounts:
    """The account number after a cue: letters, digits and hyphens, six at least, four digits in a row among them, to the end of their run.
    What is known of a run is kept, since each of many cues within one run begins in it."""

    def __init__(self, text: str):
        self.text, self.end, self.last, self.four = text, -1, -1, -1

    def at(self, start: int) -> tuple[int, int] | None:
        if start >= self.end:
            run = _ACCOUNT_RUN.match(self.text, start)
            self.end, self.last = run.end(), start + len(run[0].rstrip("-"))
            self.four = max((m.end() for m in _FOUR.finditer(self.text, start, self.end)), default=-1)
            while 0 < self.four < self.end and self.text[self.four] in _DIGITS:
                self.four += 1
        return (start, self.last) if self.last - start >= 6 and self.four - start >= 4 else None


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) spans of each kind, in code points, ascending and without overlap within a kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, accounts = dict.fromkeys(KINDS, 0), _Accounts(text)
    for last, (kind, n) in automaton().iter(text):
        at = last - n + 1
        if at < done[kind] and kind != "iban":
            continue
        if kind == "email":
            lo = _left(text, at, _LOCAL_CHARS, done[kind])
            if lo < at and (m := _DOMAIN.match(text, at)):
                found[kind].append((lo, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            lo, hi = _left(text, at, _IP_CHARS), _IP_RUN.match(text, at).end()
            found[kind] += [m.span() for m in _IP.finditer(text, lo, hi) if all(_byte(p) for p in m[0].split("."))]
            done[kind] = hi
        elif kind == "card":
            lo, hi = _left(text, at, _CARD_CHARS), _CARD_RUN.match(text, at).end()
            for m in _CARD.finditer(text, lo, hi):
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found[kind].append(m.span())
            done[kind] = hi
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found[kind].append(m.span())
                done[kind] = m.end()
        elif kind == "url":
            lo = at
            while lo > done[kind] and text[lo - 1] in _SCHEME_CHARS:
                lo -= 1
            while lo < at and text[lo] in _NOT_FIRST:
                lo += 1
            if m := _URL.match(text, lo):
                end = lo + len(m[0].rstrip(".,;:!?)]}"))
                if end > at + 3:
                    found[kind].append((lo, end))
                    done[kind] = end
        elif kind == "iban":
            # any that begins on the cue's line or within REACH characters; every stretch is searched once
            at, line = max(last + 1, done[kind]), text.find("\n", last + 1)
            end = max(len(text) if line < 0 else line, last + 1 + REACH)
            while at < end and (m := _IBAN.search(text, at, end + IBAN_MOST)) and m.start() < end:
                at = m.start() + 1
                if iban(m[0]):
                    found[kind].append(m.span())
                    at = m.end()
            done[kind] = max(at, end)
        else:
            if at and (text[at - 1].isalnum()):
                continue
            if kind == "account":
                if (m := _ACCOUNT.match(text, last + 1)) and (span := accounts.at(m.end())):
                    found[kind].append(span)
                    done[kind] = span[1]
            elif m := _SECRET.match(text, last + 1):
                found[kind].append(m.span(1))
                done[kind] = m.end()
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


_FIELDS = (*(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_spans")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = []
            for text in part.column(1).to_pylist():
                f = spans(text or "")
                rows.append((*(len(f[k]) for k in KINDS[:BASE]), hashlib.sha256(joined(f, KINDS[:BASE]).encode()).hexdigest(), joined(f, KINDS), sum(map(len, f.values()))))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string() if k in (BASE, BASE + 1) else pa.int64()) for k, c in enumerate(cols))], names=["doc_id", *_FIELDS])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row, over whole texts and without a shuffle.

    Null texts read as empty: no spans, the hash of the empty string. Null ids and repeated rows come back as they are, an empty
    table gives no rows, extra columns are not read. The counts and the hash are of the four base kinds, ``spans`` and ``n_spans`` of all.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f, T.StringType() if f in ("base_sha256", "spans") else T.LongType()) for f in _FIELDS)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_batches), schema)


def mask_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier, then the longer, wins."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, v in spans(text).items() for a, b in v), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text column; null stays null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            new = pa.array([None if t is None else mask_text(t) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    return docs.mapInArrow(lean(run), docs.schema)
