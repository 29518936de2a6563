"""Encoding of texts with a public byte-level BPE vocabulary.

Forced-boundary splitting: a byte pair that occurs inside no token of the vocabulary can never be
bridged by a merge, so the text may be cut there. Three conditions keep the pre-tokeniser's result
the same as on the uncut text: a cut never splits a character, never follows white space (its
pattern looks ahead after white space only) and never precedes an apostrophe (which would then
start a contraction instead of ending a run of signs). The fragments between cuts are short and repeat a
lot, so each distinct one is encoded once and looked up afterwards.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct fragments a worker remembers; beyond that it starts anew, with the same results.
REMEMBERED = 400_000
# The white space of the pre-tokeniser's pattern beyond ASCII, as UTF-8.
WIDE_SPACE = re.compile(rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary ``name`` lies on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Remembered(dict):
    """The ids of fragments; a fragment that is missing is encoded, and kept if it is short."""

    def __init__(self, whole):
        self.whole = whole

    def __missing__(self, fragment: bytes) -> tuple[int, ...]:
        made = tuple(self.whole.encode_ordinary(fragment.decode()))
        if len(fragment) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = made
        return made


class FragmentEncoder:
    """Encodes texts with the ranks in ``path``, without special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = read_ranks(path)
        self.whole = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(65536, bool)
        joined = np.frombuffer(b"".join(ranks), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(token) for token in ranks])
        pairs = joined[:-1] * 256 + joined[1:]
        within = np.ones(len(pairs), bool)
        within[ends[:-1] - 1] = False
        inside[pairs[within]] = True
        cut = ~inside.reshape(256, 256)
        cut[[9, 10, 11, 12, 13, 32], :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, 0x27] = False
        self.cut = cut.reshape(-1)
        self.known = Remembered(self.whole)

    def cuts(self, data: bytes) -> np.ndarray:
        """Offsets in ``data`` at which it may be cut."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.cut[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]) + 1
        if any(b in data for b in (b"\xc2", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")):
            after = [m.end() for m in WIDE_SPACE.finditer(data)]
            if after:
                at = at[~np.isin(at, after)]
        return at

    def extend(self, data: bytes, ids: array) -> None:
        """Appends the ids of the UTF-8 text ``data``."""
        ends = self.cuts(data).tolist()
        known = self.known
        ids.extend(chain.from_iterable([known[data[a:b]] for a, b in zip(chain((0,), ends), chain(ends, (len(data),)))]))

    def encode(self, text: str) -> list[int]:
        ids = array("i")
        self.extend(text.encode(), ids)
        return ids.tolist()


_ENCODERS: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    """The worker's encoder for ``path``, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(``key``, ids): the token ids of every row's ``text``, without special tokens.

    Null, empty: an empty list. Blank or unusual characters are encoded as they stand, strings that
    look like special tokens as ordinary text. Every row gives one row, repeated keys included;
    other columns are not read.
    """
    path = vocabulary or vocabulary_path()

    def encode(batches):
        coder = encoder(path)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for value in batch.column(1).cast(pa.large_binary()):
                data = value.as_py()
                if data:
                    coder.extend(data, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return _mapped(df, key, text, encode, T.StructField("ids", T.ArrayType(T.IntegerType())))


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(``key``, n_tokens): how many ids :func:`encode_corpus` gives; 0 for null and empty texts."""
    path = vocabulary or vocabulary_path()

    def count(batches):
        coder = encoder(path)
        for batch in batches:
            counts = []
            for value in batch.column(1).cast(pa.large_binary()):
                ids = array("i")
                data = value.as_py()
                if data:
                    coder.extend(data, ids)
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return _mapped(df, key, text, count, T.StructField("n_tokens", T.LongType()))


def _mapped(df: DataFrame, key: str, text: str, work, field: T.StructField) -> DataFrame:
    own = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField(key, own.schema["k"].dataType), field])
    return own.mapInArrow(work, schema)
