"""Rows of quoted, tab-separated text, found from any byte on.

A line end inside quotes is part of a cell, so where a row begins depends on all that
stands before it. What a range of bytes does to the state of the reader, however, can
be told from the range alone, once for each state it may start in. Ranges are scanned
in parallel, their transitions are chained, and each range then knows its first state.

Rules are those of the usual tab-separated readers: a quote opens a quoted cell at its
very beginning only, two quotes in it stand for one, what follows the closing quote is
plain, and CR, LF and CR LF end a row.
"""

from __future__ import annotations

import csv
import re
import sys

import numpy as np

#: states of the reader: at a row's start, at a cell's start, in a plain cell, in a
#: quoted one, and after a quote in a quoted one, which closes it or is doubled
START, CELL, PLAIN, QUOTED, CLOSING = range(5)
STATES = (START, CELL, PLAIN, QUOTED, CLOSING)
_OPENING = re.compile(rb'[\t\n\r]"')
csv.field_size_limit(sys.maxsize)  # notes may be long


def scan(data: bytes, state: int) -> tuple[np.ndarray, int]:
    """(places after the row ends in data, the state at its end), beginning in a state."""
    spans: list[tuple[int, int]] = []
    opened, at = None, 0
    if state == QUOTED or state == CLOSING and data[:1] == b'"':
        opened, at = 0, int(state == CLOSING)
    elif state in (START, CELL) and data[:1] == b'"':
        opened, at = 0, 1
    end = None
    while end is None:
        if opened is None:
            found = _OPENING.search(data, at)
            if not found:
                last = data[-1:]
                end = CELL if last == b"\t" else START if last in (b"\n", b"\r") else PLAIN if last else state
            else:
                opened, at = found.start() + 1, found.end()
            continue
        quote = data.find(b'"', at)
        if quote < 0 or quote + 1 == len(data):
            spans.append((opened, len(data)))
            end = QUOTED if quote < 0 else CLOSING
        elif data[quote + 1] == 34:
            at = quote + 2
        else:
            spans.append((opened, quote))
            opened, at = None, quote + 1
    array = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((array == 10) | (array == 13))
    if spans:
        begins, stops = np.array(spans).T
        within = np.searchsorted(begins, ends, "right") - 1
        ends = ends[(within < 0) | (ends >= stops[within])]
    return ends + 1, end


def transitions(data: bytes) -> list[int]:
    """The state at the end of data for each state at its beginning."""
    return [scan(data, state)[1] for state in STATES]


def blank(row: bytes) -> bool:
    """Rows of nothing but spaces are skipped; a tab separates two empty cells."""
    return not row.strip(b" \r\n")


def cells(row: bytes, encoding: str = "utf-8") -> list[str]:
    """The cells of one row without its end."""
    return next(csv.reader([row.decode(encoding)], delimiter="\t"), [])
