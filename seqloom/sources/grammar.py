"""A recursive-descent grammar for lines of search and feature files that recovers from errors.

A ``Reader`` is given the lines of a file in order. A record that breaks a rule gives a located error (line, column, reason).
After a broken quote what follows can't be trusted, so the reader goes on at the next line start that is validated as an
anchor: its leading fields are those of a record by the grammar. The lines before the anchor are spoiled: they aren't read as
records but belong to the error, which is located at the quote. Every readable line is an anchor, so none is lost in this way.
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

DIGITS = re.compile(r"[0-9]+\Z")
DECIMAL = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
ITEM_KEY = re.compile(r'[^\s="]+')
SPACE = re.compile(r"\s")


class Malformed(Exception):
    """A broken rule: ``reason`` is a fixed word, ``column`` counts from 1 in the line."""

    def __init__(self, reason: str, column: int, quote: bool = False):
        super().__init__(reason)
        self.reason, self.column, self.quote = reason, column, quote


class Line(NamedTuple):
    """What became of one line: ``fields`` of a record, or ``reason`` and place of an error, or neither."""

    fields: tuple | None = None
    reason: str | None = None
    line: int | None = None
    column: int | None = None
    resumed: bool = False


class Cursor:
    """A place in one line."""

    def __init__(self, text: str):
        self.text, self.at, self.end = text, 0, len(text)

    def ended(self) -> bool:
        return self.at >= self.end


# record := field (TAB field)*


def _fields(cur: Cursor, quoting: bool) -> list[tuple[str, int]]:
    out = [_field(cur, quoting)]
    while not cur.ended():
        cur.at += 1  # the tab
        out.append(_field(cur, quoting))
    return out


def _field(cur: Cursor, quoting: bool) -> tuple[str, int]:
    begin = cur.at
    if quoting and cur.text.startswith('"', begin):
        return _quoted(cur), begin
    stop = cur.text.find("\t", begin)
    cur.at = cur.end if stop < 0 else stop
    return cur.text[begin : cur.at], begin


def _quoted(cur: Cursor) -> str:
    begin = cur.at
    cur.at += 1
    parts = []
    while True:
        stop = cur.text.find('"', cur.at)
        if stop < 0:
            raise Malformed("quote_not_closed", begin + 1, quote=True)
        parts.append(cur.text[cur.at : stop])
        cur.at = stop + 1
        if not cur.text.startswith('"', cur.at):
            break
        parts.append('"')
        cur.at += 1
    if not cur.ended() and cur.text[cur.at] != "\t":
        raise Malformed("text_after_quote", cur.at + 1, quote=True)
    return "".join(parts)


def _whole(field: tuple[str, int]) -> int:
    if not DIGITS.match(field[0]):
        raise Malformed("not_a_whole_number", field[1] + 1)
    return int(field[0])


def _decimal(field: tuple[str, int], at_least_zero: bool = False) -> float:
    text, begin = field
    if not DECIMAL.match(text):
        raise Malformed("not_a_number", begin + 1)
    if at_least_zero and text[0] == "-" and re.search("[1-9]", re.split("[eE]", text)[0]):
        raise Malformed("below_zero", begin + 1)
    return float(text)


def _filled(field: tuple[str, int]) -> str:
    if not field[0]:
        raise Malformed("empty_field", field[1] + 1)
    return field[0]


def _count(fields: list[tuple[str, int]], n: int, line: str) -> None:
    if len(fields) < n:
        raise Malformed("too_few_fields", len(line) + 1)
    if len(fields) > n:
        raise Malformed("too_many_fields", fields[n][1] + 1)


def search_record(line: str) -> tuple:
    """The 12 typed fields of a tabular search line."""
    f = _fields(Cursor(line), quoting=True)
    _count(f, 12, line)
    query, subject = _filled(f[0]), _filled(f[1])
    if SPACE.search(query):
        raise Malformed("space_in_id", f[0][1] + 1)
    share = _decimal(f[2], at_least_zero=True)
    if share > 100 or (share == 100 and Decimal(f[2][0]) > 100):
        raise Malformed("above_100", f[2][1] + 1)
    counts = [_whole(x) for x in f[3:10]]
    return (query, subject, share, *counts, _decimal(f[10], True), _decimal(f[11], True))


def feature_record(line: str) -> tuple:
    """The 9 typed fields of a feature line; the last is a list of (key, value)."""
    f = _fields(Cursor(line), quoting=False)
    _count(f, 9, line)
    names = [_filled(x) for x in f[:3]]
    start, end = _whole(f[3]), _whole(f[4])
    if start < 1:
        raise Malformed("start_below_1", f[3][1] + 1)
    if start > end:
        raise Malformed("start_after_end", f[3][1] + 1)
    score = None if f[5][0] == "." else _decimal(f[5])
    if f[6][0] not in ("+", "-", ".", "?"):
        raise Malformed("unknown_strand", f[6][1] + 1)
    if f[7][0] not in ("0", "1", "2", "."):
        raise Malformed("unknown_phase", f[7][1] + 1)
    phase = None if f[7][0] == "." else int(f[7][0])
    return (*names, start, end, score, f[6][0], phase, _attributes(*f[8]))


# attributes := "." | item (";" item)*       item := key "=" value | key SPACE+ '"' value '"'


def _attributes(text: str, begin: int) -> list[tuple[str, str]]:
    if text == ".":
        return []
    items, at = [], 0
    while at <= len(text):
        stop = at
        while stop < len(text) and text[stop] != ";":
            if text[stop] == '"':
                closing = text.find('"', stop + 1)
                if closing < 0:
                    raise Malformed("quote_not_closed", begin + stop + 1, quote=True)
                stop = closing
            stop += 1
        raw = text[at:stop]
        item = raw.strip(" ")
        if item:
            items.append(_item(item, begin + at + len(raw) - len(raw.lstrip(" "))))
        at = stop + 1
    if not items:
        raise Malformed("no_attribute", begin + 1)
    return items


def _item(item: str, begin: int) -> tuple[str, str]:
    key = ITEM_KEY.match(item)
    if not key:
        raise Malformed("no_attribute_key", begin + 1)
    rest = item[key.end() :]
    if rest.startswith("="):
        if len(rest) == 1:
            raise Malformed("no_attribute_value", begin + key.end() + 1)
        return key[0], rest[1:]
    value = rest.lstrip(" ")
    if not value or value is rest or value[0] != '"':
        raise Malformed("not_an_attribute", begin + key.end() + 1)
    closing = value.find('"', 1)
    if closing != len(value) - 1:
        raise Malformed("text_after_quote", begin + len(item) - len(value) + closing + 2, quote=True)
    return key[0], value[1:-1]


RECORDS = {"m8": search_record, "gff": feature_record}


def starts_record(line: str, kind: str) -> bool:
    """Whether a line begins as a record does, by the grammar of its leading fields: an anchor at which reading may resume."""
    cur = Cursor(line)
    try:
        lead = []
        for _ in range({"m8": 3, "gff": 5}[kind]):
            lead.append(_field(cur, quoting=kind == "m8"))
            if cur.ended():
                return False
            cur.at += 1  # the tab
        if kind == "m8":
            return not SPACE.search(_filled(lead[0])) and bool(_filled(lead[1])) and _decimal(lead[2], at_least_zero=True) >= 0
        return all(_filled(x) for x in lead[:3]) and all(_whole(x) >= 0 for x in lead[3:])
    except (Malformed, KeyError):
        return False


def stripped(line: str) -> str:
    """The line without a carriage return that belongs to its end."""
    return line[:-1] if line.endswith("\r") else line


def read_line(line: str, kind: str) -> tuple | None:
    """One line's typed fields; None for a comment or blank line; raises Malformed."""
    line = stripped(line)
    if line.startswith("#") or not line.strip():
        return None
    if kind not in RECORDS:
        raise Malformed("unknown_format", 1)
    return RECORDS[kind](line)


class Reader:
    """Reads lines of one file in order. A broken quote spoils lines up to the next anchor, ``reach`` lines at most."""

    def __init__(self, reach: int):
        self.reach = reach
        self.broken: tuple[int, int] | None = None  # line and column of the last broken quote since an anchor

    def read(self, number: int, line: str, kind: str) -> Line:
        resumed = False
        if self.broken is not None:
            spoiled = number - self.broken[0] <= self.reach
            resumed = starts_record(stripped(line), kind)
            if spoiled and not resumed:
                return self._spoiled(number, line, kind)
            self.broken = None
        try:
            return Line(read_line(line, kind), resumed=resumed)
        except Malformed as error:
            if error.quote:
                self.broken = (number, error.column)
            return Line(None, error.reason, number, error.column, resumed)

    def _spoiled(self, number: int, line: str, kind: str) -> Line:
        at = self.broken
        try:
            if read_line(line, kind) is None:
                return Line()
        except Malformed as error:
            if error.quote:  # a further one, from which the reach counts anew
                self.broken = (number, error.column)
        return Line(None, "after_broken_quote", *at)
