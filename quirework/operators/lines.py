"""Text layout: which characters stand on which line of a box, and where.

A line takes as many characters as fit; it then ends at the last space on it, or,
where a word alone is wider than the box, within the word, with one character at
least. Spaces at a line's end hang over and don't count; those that begin a
paragraph do. CR LF, CR and LF end paragraphs.

From any character, where the next line would start follows from running widths
by one search. The lines of a paragraph are the chain of these jumps from its
first character; chains of many texts at once are found by pointer doubling, in
as many rounds as the longest has binary digits. So texts are laid out by whole
arrays of about a million characters, long ones paragraph by paragraph, and
nothing is shuffled: layout is a map over the table.

Widths are in thousandths of the font size and kept as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Advance widths of a plain sans-serif face, in thousandths of its size, by kind of character.
NARROW, NARROW_WIDTH = " !'(),./:;I[]fijlt|", 278
BROAD, BROAD_WIDTH = "GMOQW@%mw", 833
CAPITAL_WIDTH, OTHER_WIDTH = 667, 556
#: First and last code points of full-width scripts, and their width; combining marks have none.
FULL, FULL_WIDTH = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60)), 1000
MARKS = (0x0300, 0x036F)
#: Characters laid out at once; a longer paragraph is laid out by itself.
SLICE = 1 << 20

LINES = "line long, paragraph long, first_char long, n_chars long, width long, x double, y double"


def _table() -> np.ndarray:
    out = np.full(128, OTHER_WIDTH, np.int64)
    out[ord("A") : ord("Z") + 1] = CAPITAL_WIDTH
    for chars, width in ((NARROW, NARROW_WIDTH), (BROAD, BROAD_WIDTH)):
        out[[ord(c) for c in chars]] = width
    return out


def advances(points: np.ndarray) -> np.ndarray:
    """The width of each code point."""
    out = np.where(points < 128, _table()[np.minimum(points, 127)], OTHER_WIDTH)
    for low, high in FULL:
        out[(points >= low) & (points <= high)] = FULL_WIDTH
    out[(points >= MARKS[0]) & (points <= MARKS[1])] = 0
    return out


def reached(following: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which places the chains from first come by: following is the next place of each, itself at a chain's end."""
    on = np.zeros(len(following), bool)
    on[first] = True
    jump = following
    while True:
        n = np.count_nonzero(on)
        on[jump[np.flatnonzero(on)]] = True
        if np.count_nonzero(on) == n:
            return on
        jump = jump[jump]


def broken(points: np.ndarray, text: np.ndarray, most: int, indent: int) -> tuple[np.ndarray, ...]:
    """Lines of several texts: text, paragraph, first character (both from 0 in their text), characters and width.

    points: code points of all texts, each text ended by a line feed, with CR LF
    and CR as line feeds already. text: the number of each one's text. most: the
    width of a line; indent: what the first one of a paragraph has less.
    """
    n = len(points)
    at = np.arange(n)
    ends, space = points == 10, points == 32
    wide = np.r_[0, np.cumsum(np.where(ends, 0, advances(points)))]
    end = np.minimum.accumulate(np.where(ends, at, n)[::-1])[::-1]  # the paragraph's end
    begins = np.r_[True, ends[:-1]]
    begin = np.maximum.accumulate(np.where(begins, at, 0))
    filled = np.where(ends | space, -1, at)
    last_filled = np.maximum.accumulate(filled)  # the last character that is seen, here or before
    next_filled = np.minimum.accumulate(np.where(space, n, at)[::-1])[::-1]  # the first one here or later that is no space
    last_space = np.maximum.accumulate(np.where(space, at, -1))

    room = most - indent * begins
    fits = np.minimum(np.searchsorted(wide, wide[:-1] + room, side="right") - 1, end)
    fits = np.maximum(fits, at)
    rest = next_filled[np.minimum(fits, n - 1)]  # what follows, less spaces that hang over
    before = np.maximum(fits - 1, 0)
    cut = last_space[before]  # the last space that fits
    ended = last_filled[np.maximum(cut, 0)]  # the last character before it
    whole = rest == end
    at_space = space[np.minimum(fits, n - 1)]
    soft = (cut > at) & (ended >= at) & (fits > at)
    start = np.where(whole, end + 1, np.where(at_space, rest, np.where(soft, cut + 1, np.maximum(fits, at + 1))))
    stop = np.where(whole | at_space, last_filled[before], np.where(soft, ended, np.maximum(fits, at + 1) - 1)) + 1
    start = np.where(ends, at + 1, start)
    stop = np.where(ends, at, stop)
    # A paragraph's end is a place of its own, from which the next paragraph starts, so that all lines of a text are one chain.
    following = np.where((start >= n) | (text[np.minimum(start, n - 1)] != text), at, start)
    line = np.flatnonzero(reached(following, np.flatnonzero(np.r_[True, text[1:] != text[:-1]])))
    first = np.searchsorted(text, text[line])
    paragraphs = np.cumsum(begins)
    stopped = np.maximum(stop[line], line)
    return text[line], paragraphs[line] - paragraphs[first], line - first, stopped - line, wide[stopped] - wide[line], begin[line] == line


def _pieces(texts: list[str], most: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """(number of the text, paragraphs and characters before, characters), of about most characters in all; long texts are cut between paragraphs."""
    held, out = 0, []
    for i, t in enumerate(texts):
        paragraph = low = 0
        while low < len(t):
            high = len(t)
            if high - low > most:
                cut = t.rfind("\n", low, low + most)
                cut = t.find("\n", low + most) if cut < 0 else cut
                high = len(t) if cut < 0 else cut + 1
            piece = t[low:high]
            out.append((i, paragraph, low, piece.removesuffix("\n")))
            held += len(piece)
            if held > most:
                yield out
                held, out = 0, []
            paragraph, low = paragraph + piece.count("\n"), high
    if out:
        yield out


def _lines(columns: list[str], text_col: str, most: int, indent: int, size: float, line_height: float, alignment: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in batch.column(text_col).to_pylist()]
            so_far = np.zeros(len(texts), np.int64)  # lines
            for pieces in _pieces(texts, SLICE):
                of, paragraphs, chars, words = zip(*pieces, strict=True)
                points = np.frombuffer("".join(w + "\n" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                piece, paragraph, first, n, width, opening = broken(points, np.repeat(np.arange(len(words)), [len(w) + 1 for w in words]), most, indent)
                owner = np.array(of)[piece]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner) + so_far[owner]
                np.add.at(so_far, owner, 1)
                left = indent * opening + (most - indent * opening - width) * (0, 1, 2)[alignment] // 2
                own = batch.take(pa.array(owner))
                found = [number, paragraph + np.array(paragraphs)[piece], first + np.array(chars)[piece], n, width, left * size / 1000, number * (line_height * size)]
                arrays = [own.column(c) for c in columns] + [pa.array(a) for a in found]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def of_text(text: str | None, width: float, size: float, line_height: float = 1.2) -> Iterator[tuple]:
    """The lines of one text, set to the left, in LINES' columns."""
    plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    number = 0
    for pieces in _pieces([plain], SLICE):
        for _, paragraphs, chars, words in pieces:
            points = np.array([*map(ord, words), 10], np.int64)
            for paragraph, first, n, wide in zip(*(a.tolist() for a in broken(points, np.zeros(len(points), np.int64), round(width / size * 1000), 0)[1:5]), strict=True):
                yield number, paragraphs + paragraph, chars + first, n, wide, 0.0, number * (line_height * size)
                number += 1


def laid_out(texts: DataFrame, width: float, text_col: str = "text", size: float = 12.0, line_height: float = 1.2, first_line_indent: float = 0.0, left_indent: float = 0.0, right_indent: float = 0.0, alignment: int = 0) -> DataFrame:
    """One row for each line of each text: its other columns, then those of LINES.

    width, size and indents are in points; alignment 1 centres, 2 sets to the
    right, all else to the left. first_char and n_chars count code points of the
    text with CR LF as one; width is that of the seen characters in thousandths
    of size, x and y where the line stands in the box. A null or empty text has
    no line, an empty paragraph one without characters; a line break at the
    text's end opens none. A box without room for a character holds one a line.
    Columns named like those of LINES are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [c for c in texts.columns if c != text_col and c not in [x.split()[0] for x in LINES.split(", ")]]
    taken = texts.select(text_col, *own)
    spark = texts.sparkSession
    out = spark.createDataFrame([], taken.select(*own).schema).schema
    for f in spark.createDataFrame([], LINES).schema:
        out = out.add(f)
    units = lambda points: round(points / size * 1000)
    most = units(width - left_indent - right_indent)
    found = taken.mapInArrow(_lines(own, text_col, most, units(first_line_indent), size, line_height, alignment if alignment in (1, 2) else 0, to_arrow_schema(out)), out)
    return found.withColumn("x", found.x + left_indent) if left_indent else found
