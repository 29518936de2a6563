"""Vector tables: tokens, hashed features, point ids, upserts, size checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.evidence import canonical_json

# Words that stand for others as well.
ALIASES = {
    "bcl": ["burkholderia", "cepacia", "lipase"], "zif-8": ["zif", "mof", "metal", "organic", "framework"], "mof": ["metal", "organic", "framework"], "immobilization": ["immobilized", "carrier", "support"],
    "immobilisation": ["immobilized", "carrier", "support"], "transesterification": ["biodiesel", "esterification"], "reusability": ["reuse", "cycles", "stability"],
}
TOKEN = r"[A-Za-z][A-Za-z0-9\-]{1,}|[0-9]+(?:\.[0-9]+)?%?"


def tokens(text: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Lower-cased ASCII words and numbers without outer hyphens, each followed by its aliases; empty for null."""
    aliases = ALIASES if aliases is None else aliases
    bare = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), lambda t: F.regexp_replace(F.lower(t), r"^-+|-+$", ""))
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,array<string>>")
    return F.flatten(F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def bigrams(words: Column) -> Column:
    """Neighbouring ``words`` joined by an underscore."""
    short = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), short), F.slice(words, F.lit(2), short), lambda a, b: F.concat_ws("_", a, b))


def feature(name: str, dimensions: int) -> tuple[int, float]:
    """Place and sign of a hashed feature: 64 bits of blake2b, the top bit is the sign."""
    value = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
    return value % dimensions, -1.0 if value >> 63 else 1.0


class HashEmbedder:
    """Deterministic embedding: the signed bag of hashed features, of length one (zero if there is none)."""

    def __init__(self, dimensions: int = 384):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.dimensions, self.name = dimensions, f"hash-v1-{dimensions}"

    def vectors(self, features: Column) -> Column:
        """The vectors of a column of feature lists; Arrow batches, each distinct feature hashed once a batch."""
        size = self.dimensions

        @F.arrow_udf("array<double>")
        def embed(lists: pa.Array) -> pa.Array:
            names = lists.flatten().dictionary_encode()
            hashed = [feature(name, size) for name in names.dictionary.to_pylist()]
            places, signs = np.array([at for at, _ in hashed], np.int64), np.array([sign for _, sign in hashed])
            which, row = names.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            sums = np.bincount(row * size + places[which], signs[which], len(lists) * size).astype(float).reshape(-1, size)
            norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            flat = np.divide(sums, norms, out=sums, where=norms > 0).ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * size, pa.int32()), pa.array(flat))

        return embed(features)

    def embed(self, text: Column) -> Column:
        return self.vectors(X.let(tokens(text), lambda words: F.concat(words, bigrams(words))))


class SentenceEmbedder:
    """Embedding by a sentence model that ``load`` returns: a callable from a list of texts to rows of numbers.

    The model is loaded once a worker, when its first batch comes; vectors of another size are an error.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimensions: int, name: str = "sentence", batch: int = 32):
        if dimensions <= 0 or batch <= 0:
            raise ValueError("dimensions and batch must be positive")
        self.load, self.dimensions, self.name, self.batch = load, dimensions, name, batch

    def embed(self, text: Column) -> Column:
        load, size, step = self.load, self.dimensions, self.batch

        @F.pandas_udf("array<double>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = None
            for texts in batches:
                model = model or load()
                plain = texts.fillna("").tolist()
                rows = [np.asarray(r, float) for at in range(0, len(plain), step) for r in model(plain[at : at + step])]
                if len(rows) != len(plain) or any(r.shape != (size,) for r in rows):
                    raise ValueError("the model's vectors don't fit")
                yield pd.Series(rows)

        return made(text)


PROVIDERS: dict[str, Callable] = {"hash_v1": HashEmbedder, "sentence": SentenceEmbedder}


def provider(kind: str, **options):
    """The embedding that is registered as ``kind``; an unknown kind is an error."""
    if kind not in PROVIDERS:
        raise ValueError(f"unknown embedding: {kind}")
    return PROVIDERS[kind](**options)


def points(chunks: DataFrame, tables: DataFrame, evidence: DataFrame, embedder=None) -> DataFrame:
    """The points of chunks (of both kinds), tables and evidence records: one a row, ids by content key.

    ``evidence``: records with evidence_id. ``vector`` is there if an embedding is given. What is flagged, or
    is a record to review, is not usable for ranking.
    """
    flagged = F.size("quality_flags") > 0
    words = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    base = ["document_id", "source_pdf", "section", "page_start", "page_end", "quality_flags"]
    cited = X.citation(F.col("source_pdf"), F.col("document_id"), F.col("page_start"), F.col("page_end"))
    a = chunks.select(
        F.concat(F.lit("chunk:"), "chunk_id").alias("payload_key"), F.lit("rag_chunk").alias("point_type"), F.col("chunk_id").alias("source_id"), "chunk_type", *base, "signals", flagged.alias("requires_review"), cited.alias("citation"), "text",
        X.joined_parts(F.col("section"), words(F.col("signals")), F.col("text")).alias("_embed"),
    )
    said = X.joined_parts(F.col("caption"), F.col("text"))
    b = tables.withColumns({"page_start": F.col("page_idx"), "page_end": F.col("page_idx"), "text": said}).select(
        F.concat(F.lit("table:"), "table_id").alias("payload_key"), F.lit("table_record").alias("point_type"), F.col("table_id").alias("source_id"), *base, "signals", "caption", "columns", "row_count", flagged.alias("requires_review"),
        X.citation(F.col("source_pdf"), F.lit(None).cast("string"), F.col("page_start"), F.col("page_end")).alias("citation"), "text", X.joined_parts(F.col("caption"), words(F.col("signals")), F.col("text")).alias("_embed"),
    )
    c = evidence.select(
        F.concat(F.lit("evidence:"), "evidence_id").alias("payload_key"), F.lit("evidence_record").alias("point_type"), F.col("evidence_id").alias("source_id"), F.col("source_id").alias("parent_source_id"), *base, "record_type", "review_reasons", "confidence", "extracted", "metrics", "requires_review",
        cited.alias("citation"), F.coalesce("evidence_span", F.lit("")).alias("text"), X.joined_parts(F.col("record_type"), canonical_json(F.col("extracted")), canonical_json(F.to_json("metrics")), F.col("evidence_span")).alias("_embed"),
    )
    every = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    vector = [embedder.embed(F.col("_embed")).alias("vector")] if embedder else []
    return every.select(X.name_uuid(F.col("payload_key")).alias("id"), *vector, "*", (~F.col("requires_review")).alias("usable_for_ranking")).drop("_embed")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` without the keys of ``new``, and of ``new`` the last row of each key by ``order``."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(fresh)


def named_size(vectors: dict) -> int | None:
    """The size of a collection's vectors: one set ({"size": n}) or several named ones that agree; None if they don't."""
    if isinstance(vectors.get("size"), int):
        return vectors["size"]
    sizes = {v["size"] for v in vectors.values() if isinstance(v, dict) and isinstance(v.get("size"), int)}
    return sizes.pop() if len(sizes) == 1 else None


class Collection:
    """A vector collection as a folder of parquet files, whose size stands in its properties file.

    ``ensure`` creates it, or checks the size of the one there; ``recreate`` drops it first. Writing
    and searching check the size of what they get. Upserts replace points of the same id, the last of
    a batch wins; the files are partitioned by point_type, so a search by type reads only those.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def size(self) -> int | None:
        """The size of its vectors, None if there is no collection."""
        path, files = self._path("properties")
        return named_size(json.loads(self.spark.read.text(path.toString()).head()[0])) if files.exists(path) else None

    def ensure(self, size: int, recreate: bool = False) -> None:
        if recreate:
            self.drop()
        there = self.size()
        if there is not None and there != size:
            raise RuntimeError(f"the collection has vectors of {there} numbers, not {size}")
        if there is None:
            self.spark.createDataFrame([(json.dumps({"size": size, "distance": "Cosine"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/properties")

    def drop(self) -> None:
        path, files = self._path("")
        files.delete(path, True)

    def points(self) -> DataFrame:
        size = self.size()
        if size is None:
            raise RuntimeError("there is no such collection")
        current, files = self._path("current")
        return self.spark.read.parquet(f"{self.folder}/points/{self.spark.read.text(current.toString()).head()[0]}")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Writes ``rows`` (id, vector, point_type, ...) beside the points kept, as a new version, then points to it; the old version is dropped."""
        size = self.size()
        if size is None:
            raise RuntimeError("there is no such collection")
        if rows.where(F.coalesce(F.size("vector"), F.lit(-1)) != size).limit(1).count():
            raise RuntimeError(f"a vector has not {size} numbers")
        current, files = self._path("current")
        old = self.spark.read.text(current.toString()).head()[0] if files.exists(current) else None
        fresh = upsert(self.points(), rows, "id", order or "id") if old else upsert(rows.limit(0), rows, "id", order or "id")
        version = f"v{int(old[1:]) + 1 if old else 1}"
        fresh.write.mode("overwrite").partitionBy("point_type").parquet(f"{self.folder}/points/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current")
        if old:
            files.delete(self._path(f"points/{old}")[0], True)


def vector_size(df: DataFrame, vector: str = "vector") -> int:
    """The one size of all non-empty vectors; an error if they differ or there is none."""
    sizes = [r[0] for r in df.where(F.size(vector) > 0).select(F.size(vector)).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("the vectors have no common size" if sizes else "there are no vectors")
    return sizes[0]
