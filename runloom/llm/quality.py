"""Operator 9, quality rules: line-first cleaning.

Every line is judged by itself: a line fails if no word in it ends a sentence (punctuation), if it is mostly
separators or markup symbols (navigation), if it is capitals or one word said again and again, or if it is a short stock
phrase (boilerplate).  Failing lines are removed; a document that loses more than ``MAX_LOST`` of its word
characters is rejected, as is one that fails the base rules (too short, too repetitive).

Nulls and empty texts have no words and fail the base rules; repeated rows are judged alike, one result row each;
texts of any length are judged whole; an empty table gives none; other columns pass through unless a result column has the same name, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

MIN_WORDS = 50
#: Percent of the words that may be in repeated three-word windows
MAX_REPEAT = 50
MAX_LOST = 0.5
#: Share of a line's words that may be bare separators or carry runs of symbols
MAX_SYMBOL_WORDS = 0.25
#: Share of a line's words that may equal the word before
MAX_STUTTER = 0.4
STOCK_MAX_WORDS = 12
# Fixed phrases of site boilerplate, in lower case.
STOCK_PHRASES = r"all rights reserved|cookie|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|read more|click here|javascript|share this|back to top|licensed under|copyright"

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_END = np.zeros(256, bool)
_END[list(b".!?:;")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|<>/#*$%&-=_~+")] = True


def _judge(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = B.words(buf, offs)
    n_words = np.diff(first)
    char = B.IS_CHAR_START[buf]
    word_chars = B.per_row(char & ~B.IS_SPACE[buf], offs)
    n_symbols = B.per_row(_SYMBOL[buf], offs)

    prefix = B.prefix_hash(buf)
    word_hash = B.range_hash(prefix, starts, ends)
    row_of_word = np.repeat(np.arange(len(offs) - 1), n_words)

    # words in three-word windows that are found twice
    h, at, bounds = B.windows_hash(word_hash, first, 3)
    twice, _ = B.repeated(h, np.repeat(np.arange(len(offs) - 1), np.diff(bounds)))
    marked = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        marked[at[twice] + k] = True
    n_repeat = B.per_row(marked[: len(starts)], first)

    # lines
    l_start, l_end, l_first = B.lines(buf, offs)
    row_of_line = np.repeat(np.arange(len(offs) - 1), np.diff(l_first))
    w_first = np.searchsorted(starts, l_start)
    w_last = np.searchsorted(starts, l_end)
    line_words = w_last - w_first
    spoken = line_words > 0
    _, later = B.repeated(B.range_hash(prefix, l_start, l_end), np.where(spoken, row_of_line, -1 - np.arange(len(l_start))))
    n_dup = B.per_row(later & spoken, l_first)

    def by_line(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[w_last] - total[w_first]

    size = ends - starts
    last = buf[ends - 1] if len(ends) else np.empty(0, np.uint8)
    before = buf[np.maximum(ends - 2, starts)] if len(ends) else last
    third = buf[np.maximum(ends - 3, starts)] if len(ends) else last
    # the UTF-8 of the ellipsis, closing quotes and full-width stops ends in one of these after E2/E3/C2
    wide = (third == 0xE2) & (before == 0x80) & np.isin(last, [0xA6, 0x9D, 0x99]) | (third == 0xE3) & (before == 0x80) & (last == 0x82) | (before == 0xC2) & (last == 0xBB)
    stop = _END[last] | _CLOSER[last] & _END[before] | wide
    run = _SYMBOL[last].astype(bool) & (size >= 3) & (last == before) & (before == third)
    bare = _SEPARATOR[last] & _SEPARATOR[buf[starts] if len(starts) else last] & (size <= 3)
    stutter = np.zeros(len(starts), bool)
    if len(starts) > 1:
        stutter[1:] = (word_hash[1:] == word_hash[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    up = (buf >= 65) & (buf <= 90)
    low = (buf >= 97) & (buf <= 122)
    if len(buf) > 1:
        latin = buf[:-1] == 0xC3
        up[1:] |= latin & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        low[1:] |= latin & (buf[1:] >= 0x9F) & (buf[1:] <= 0xBF)
    flat = np.append(np.stack([l_start, np.maximum(l_end, l_start)], 1).ravel(), len(buf))
    ups = B.per_row(up, flat)[0::2]
    lows = B.per_row(low, flat)[0::2]

    fails = by_line(stop) == 0
    fails |= by_line(run | bare) > MAX_SYMBOL_WORDS * line_words
    fails |= (by_line(stutter) > MAX_STUTTER * line_words) & (line_words >= 5)
    fails |= (ups > 4 * lows) & (ups >= 20)
    short = np.flatnonzero(spoken & ~fails & (line_words <= STOCK_MAX_WORDS))
    if len(short):
        text = B.strings(buf[_ranges(l_start[short], l_end[short])], np.concatenate([[0], np.cumsum(l_end[short] - l_start[short])]))
        fails[short] = pc.match_substring_regex(pc.utf8_lower(pa.array(text)), STOCK_PHRASES).to_numpy(zero_copy_only=False)
    fails &= spoken

    chars = B.per_row(char & ~B.IS_SPACE[buf], flat)[0::2]
    lost = B.per_row(np.where(fails, chars, 0), l_first)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & (lost <= MAX_LOST * word_chars), "lines": (l_start, l_end, l_first, fails)}


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = np.maximum(end - start, 0)
    total = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - total[:-1], size) + np.arange(total[-1])


def _clean(buf: np.ndarray, offs: np.ndarray, parts: tuple) -> list[str]:
    l_start, l_end, l_first, fails = parts
    out = B.strings(buf, offs)
    lost = B.per_row(fails, l_first)
    for i in np.flatnonzero(lost):
        out[i] = "\n".join(x for x, f in zip(out[i].split("\n"), fails[l_first[i] : l_first[i + 1]], strict=True) if not f)
    return out


def quality_rules(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """Adds the counts, base_failed, kept and (if ``clean``) clean_text, the text without its failing lines."""
    added = [c for c in RESULT.split(", ") if clean or not c.startswith("clean_text")]
    names = {c.split()[0] for c in added}
    rest = [c for c in docs.columns if c not in names and (clean or c != text)]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(rest))
            for lo, hi, buf, offs in B.text_chunks(column):
                got = _judge(buf, offs)
                parts = got.pop("lines")
                new = [pa.array(v) for v in got.values()]
                if clean:
                    new.append(pa.array(_clean(buf, offs, parts), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], *new], [*rest, *(c.split()[0] for c in added)])

    from pyspark.sql.types import StructType

    schema = StructType([*(source.schema[c] for c in rest), *StructType.fromDDL(", ".join(added)).fields])
    return source.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, all columns, with clean_text as their text; n_chars, if there, follows it."""
    aside = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    judged = quality_rules(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()]), aside[text]).where("kept")
    values = {c: F.col(a) for c, a in aside.items() if c != text} | {text: F.col("clean_text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[values[c].alias(c) for c in docs.columns])
