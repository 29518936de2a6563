"""Splitting of oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The separator hierarchy, from the strongest pause to the weakest. A text is cut after a match.
SECTION = re.compile(r"\f+|\n\s*\n(?=\s*(?:#{1,6}\s|\d+(?:\.\d+)*\.?\s+\w[^\n]{0,80}\n))|(?:[^\S\n]*\n){3,}")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*| \s*")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]»]*\s+(?![a-z\d])|[。！？]+[”’」』）]*\s*|(?<=[;:；])\s*\n\s*|\n\s*(?=[-•*–(]|\d+[.)])")
CLAUSE = re.compile(r"[;；]\s*|\n\s*")
WORD = re.compile(r"\s+|(?<=[-‐–—/,;:，、：])(?=\w)")
LEVELS = (SECTION, PARAGRAPH, SENTENCE, CLAUSE, WORD)


def _clings(text: str, at: int) -> bool:
    """Whether the character at ``at`` belongs to the one before it (marks, joiners, variation selectors)."""
    char = text[at]
    return char in "‍︎️" or "\U0001f3fb" <= char <= "\U0001f3ff" or text[at - 1] == "‍" or unicodedata.combining(char) != 0


def _atoms(text: str, start: int, end: int, room: int, level: int, ends: list[int]) -> None:
    """Appends the ends of the spans of at most ``room`` that ``text[start:end]`` falls into, cut at the strongest level that suffices."""
    if end - start <= room:
        ends.append(end)
    elif level == len(LEVELS):
        while end - start > room:
            cut = start + room
            while cut > start + max(1, room // 2) and _clings(text, cut):
                cut -= 1
            ends.append(cut)
            start = cut
        ends.append(end)
    else:
        for match in LEVELS[level].finditer(text, start, end):
            if start < match.end() < end:
                _atoms(text, start, match.end(), room, level + 1, ends)
                start = match.end()
        _atoms(text, start, end, room, level + 1, ends)


def piece_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece, in order: end - start <= ``limit``; each start is the last end less ``overlap``.

    Offsets are code points. The pieces cover the text; a text within the limit is one piece, an empty one none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends: list[int] = []
    _atoms(text, 0, len(text), limit - overlap, 0, ends)
    spans, start, last = [], 0, 0
    for end in ends:
        if end - start > limit:
            spans.append((start, last))
            start = last - overlap
        last = end
    spans.append((start, last))
    return spans


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """(``keys``, n_pieces, piece_no, piece_start, piece_end, piece): the ordered pieces of every text.

    Null and empty texts give no piece; texts within ``limit`` code points give one, without leaving
    the JVM. Longer ones are cut by section, paragraph, sentence, word and character, whichever is
    the strongest that suffices, and the spans are packed greedily; each piece after the first
    starts with the last ``overlap`` code points of the one before. Repeated rows give repeated
    pieces. Only ``keys`` and ``text`` are read, so other columns may have any name.
    """
    own = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    names = [f"k{i}" for i in range(len(keys))]
    schema = T.StructType(
        [T.StructField(n, own.schema[n].dataType) for n in names]
        + [T.StructField("n_pieces", T.IntegerType()), T.StructField("piece_no", T.IntegerType()), T.StructField("piece_start", T.IntegerType()), T.StructField("piece_end", T.IntegerType()), T.StructField("piece", T.StringType())]
    )
    columns = schema.fieldNames()

    def cut(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                spans = piece_spans(row[-1], limit, overlap)
                rows += [(*row[:-1], len(spans), n, a, b, row[-1][a:b]) for n, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=columns)

    size = F.length("t")
    one = own.where((size > 0) & (size <= limit)).select(*names, F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_no"), F.lit(0).alias("piece_start"), size.cast("int").alias("piece_end"), F.col("t").alias("piece"))
    many = own.where(size > limit).mapInPandas(cut, schema)
    return one.unionByName(many).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *columns[len(keys):])


def oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """(``keys``): the rows whose text :func:`split_oversized` cuts into several pieces, each key once."""
    return split_oversized(df, keys, text, limit, overlap).where("n_pieces > 1").select(*keys).distinct()
