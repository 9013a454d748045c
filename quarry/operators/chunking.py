"""Chunks of source texts with exact code-point offsets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .shared import let

PIECES = "array<struct<start:bigint,text:string>>"


def _require_sizes(size: int, overlap: int) -> None:
    """Windows must move on: each begins at least one character after the last."""
    if size <= max(1, overlap) or overlap < 0:
        raise ValueError(f"windows of {size} characters cannot overlap by {overlap}")


def character_windows(text: Column, size: int = 320, overlap: int = 40) -> Column:
    """Windows of size characters every size - overlap; stripped, their starts moved along, blank ones dropped."""
    _require_sizes(size, overlap)
    step = size - overlap
    more = -(-overlap // step)  # pieces that a window reaches into behind its own

    def windows(pieces):
        def window(piece, i):
            raw = F.substring(F.array_join(F.slice(pieces, i + 1, more + 1), ""), 1, size)
            lead = F.length(raw) - F.length(F.regexp_replace(raw, "(?U)^\\s+", ""))
            return F.struct((i * step + lead).cast("long").alias("start"), strip(raw).alias("text"))

        return F.filter(F.transform(pieces, window), lambda w: w["text"] != "")

    # one pass over the text: every piece is cut off where the last one ended
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), windows)


BLANK = re.compile(r"\s+")
#: Marks after which white space ends a sentence.
SENTENCE_END = frozenset(".!?;")


class Gaps:
    """The runs of white space of a text, found once: every place where a window may end or begin lies at one."""

    def __init__(self, text: str):
        self.text = text
        self.begins, self.ends = [], []
        for m in BLANK.finditer(text):
            self.begins.append(m.start())
            self.ends.append(m.end())

    def stop(self, start: int, least: int, limit: int) -> int:
        """Where a window from start ends: the last paragraph break between least and limit, else the last sentence
        end, else the last gap, else limit itself. A gap that reaches over limit ends there."""
        sentence = gap = None
        for i in range(bisect_left(self.begins, limit) - 1, -1, -1):
            begin, end = max(self.begins[i], start), min(self.ends[i], limit)
            if end < least:
                break
            feed = self.text.rfind("\n", begin, end)
            if feed + 1 >= least and self.text.find("\n", begin, end) < feed:
                return feed + 1
            gap = end if gap is None else gap
            if sentence is None and begin > start and self.text[begin - 1] in SENTENCE_END:
                sentence = end
        return sentence or gap or limit

    def after(self, at: int, stop: int) -> int:
        """The end of the first gap at or after `at` that begins before stop; `at` if there is none."""
        i = bisect_right(self.ends, at)
        return min(self.ends[i], stop) if i < len(self.ends) and self.begins[i] < stop else at


def cut_paragraphs(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of stripped windows of at most size characters, each from overlap characters before the last
    one's end, moved to the next word; see Gaps.stop for where they end. Blank windows are left out."""
    gaps, out, start = Gaps(text), [], 0
    while start < len(text):
        final = start + size >= len(text)
        stop = len(text) if final else gaps.stop(start, start + size // 2, start + size)
        if kept := text[start:stop].strip():
            out.append((text.index(kept[0], start), kept))
        if final:
            return out
        start = gaps.after(max(start + 1, stop - overlap), stop)
    return out


def paragraph_windows(text: Column, size: int = 1200, overlap: int = 160) -> Column:
    """cut_paragraphs as a column: each window depends on the one before, which no built-in expresses."""
    _require_sizes(size, overlap)
    return F.udf(lambda t: cut_paragraphs(t or "", size, overlap), PIECES, useArrow=True)(text)


def distinct_windows(windows: Column) -> Column:
    """Windows by start, of equal texts the first: equal ones stand together once sorted."""

    def firsts(s: Column) -> Column:
        new = F.filter(s, lambda x, i: (i == 0) | (x["text"] != F.get(s, i - 1)["text"]))
        return F.array_sort(F.transform(new, lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text"))))

    return let(F.array_sort(F.transform(windows, lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start")))), firsts)


def markdown_pieces(body: Column, most: int = 900, gap: str = "\n\n") -> Column:
    """Paragraphs packed in order into pieces of at most `most` characters; a longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(body, gap), strip), lambda p: p != "")

    def add(done, p):
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit("\n\n"), p)
        fits = (F.size(done) > 0) & (F.length(last) + 2 + F.length(p) <= most)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), lambda done, p: F.when(F.size(done) == 0, F.array(p)).otherwise(add(done, p)))


def explode_windows(docs: DataFrame, windows: Column) -> DataFrame:
    """A row for each window: docs' columns, its char_start and text."""
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(*kept, F.explode(windows).alias("w")).select(*kept, F.col("w.start").alias("char_start"), F.col("w.text").alias("text"))
