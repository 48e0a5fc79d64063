"""Pre-tokens of two public tokenizer patterns, found on arrays of code points instead of by a regular expression.

Both patterns cut a text into runs of letters, numbers and other characters; they differ in what they do with white space, digits
and apostrophes. tests/llm hold both against the regular expressions themselves.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
#: White_Space of the Unicode database, which is what \s means in both patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point, from its general category."""
    letters = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((letters.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[ord(c) for c in WHITE]] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a UTF-8 buffer, the byte at which each starts (and the end), and the offsets of rows in code points."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, np.arange(len(data) + 1), offsets
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return points, at, np.searchsorted(at, offsets)


def _edges(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, whether it is the first or last of its row, and whether a run of one class starts there."""
    n = len(points)
    kind = class_table()[points]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[rows[:-1][rows[:-1] < n]] = True
    last[rows[1:][rows[1:] > 0] - 1] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    return kind, first, last, run


def _contractions(points: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes at `at`, those that begin 's 't 'm 'd 're 've 'll in their row, and the length of each with the apostrophe."""
    at = at[~last[at]]
    one = points[at + 1]
    two = np.where(last[at + 1], 0, points[np.minimum(at + 2, len(points) - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    return at[short | long], np.where(short, 2, 3)[short | long]


def spaced_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of public_tokenizers.PATTERN start; together they cover everything.

    A space before a run joins the run; of white space before something else the last character stands alone, unless it is such a space."""
    if not len(points):
        return np.zeros(0, np.int64)
    kind, first, last, run = _edges(points, rows)
    space, blank = kind == SPACE, points == 32
    after_blank = np.zeros(len(points), bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    before_other = np.zeros(len(points), bool)
    before_other[:-1] = ~space[1:]
    before_other &= ~last
    start = run & (space | ~after_blank) | space & before_other
    at, size = _contractions(points, last, np.flatnonzero(start & (points == 39)))
    start[at + 1] = False
    goes_on = ~last[at + size - 1]
    start[(at + size)[goes_on]] = True
    return np.flatnonzero(start)


def bare_spans(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+; white space is left out."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, _, last, run = _edges(points, rows)
    start = (run | (kind == NUMBER)) & (kind != SPACE)
    at, size = _contractions(points, last, np.flatnonzero(run & (points == 39)))
    start[at + 1] = False
    goes_on = ~last[at + size - 1]
    rest = (at + size)[goes_on]
    start[rest[kind[rest] != SPACE]] = True
    starts = np.flatnonzero(start)
    stop = start | (kind == SPACE)
    edge = np.append(np.flatnonzero(stop), len(points))
    ends = edge[np.searchsorted(edge, starts, "right")]
    following = rows[np.minimum(np.searchsorted(rows, starts, "right"), len(rows) - 1)]
    return starts, np.minimum(ends, following)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of data end to end."""
    total = int(lengths.sum())
    return data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]
