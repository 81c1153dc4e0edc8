"""Nearest vectors, by tiles of queries and vectors, and the work of making vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows_of(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size: places and unit vectors of those that aren't null or zero and have no nulls."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        norm = np.linalg.norm(m, axis=1)
        ok = norm > 0  # not of those with nulls either, which come as NaN
        out[size] = at[ok], m[ok] / norm[ok, None]
    return out


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", k: int = 20, least: float = 0.45, asked_rows: int = 1024, tile_rows: int = 8192) -> DataFrame:
    """(query, key, cosine, rank): the k nearest vectors of each query, of those with a cosine of `least` or more.

    Both sides are dealt into tiles of about so many rows, and each pair of tiles meets in one task, which gives its k best
    of each query by one matrix product; only these are merged. Vectors are read once, and nothing passes through the driver
    but two counts. Null and zero vectors, and other sizes, match nothing.
    """
    tiles = lambda df, rows: max(1, -(-df.count() // rows))
    across, down = tiles(queries, asked_rows), tiles(vectors, tile_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda c, v, n: F.pmod(F.xxhash64(c, v), F.lit(n)).cast("int")
    asked = queries.select(F.col(query).alias("id"), F.col(vector).alias("v")).dropna().select("id", "v", tile("id", "v", across).alias("q"), every(down).alias("t"))
    known = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL").select("id", "v", tile("id", "v", down).alias("t"), every(across).alias("q"))

    def near(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ours, others = _rows_of(mine["v"]), _rows_of(theirs["v"])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for size in ours.keys() & others.keys():
            (a, x), (b, y) = ours[size], others[size]
            if len(a) and len(b):
                close = x @ y.T
                n = min(k, len(b))
                bound = np.partition(close, len(b) - n, axis=1)[:, len(b) - n : len(b) - n + 1]
                q, i = np.nonzero(close >= np.maximum(bound, least))
                found.append((a[q], b[i], close[q, i]))
        q, i, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({query: mine["id"].take(pa.array(q)), key: theirs["id"].take(pa.array(i)), "cosine": pa.array(cosine)})

    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("cosine", T.DoubleType())])
    out = asked.groupBy("q", "t").cogroup(known.groupBy("q", "t")).applyInArrow(near, schema)
    order = Window.partitionBy(query).orderBy(F.desc("cosine"), key)
    return out.withColumn("cosine", F.round("cosine", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embed_text(texts: DataFrame, key: str, load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], model: str, text: str = "text", batch: int = 64) -> DataFrame:
    """(key, hash, model, embedding): the vectors that an encoder makes of texts, at length 1.

    load() is called once in each Python worker and gives the encoder: from a list of texts to the vectors of their tokens
    (texts x tokens x size) and a mask (texts x tokens). An embedding is the mean of the vectors that the mask keeps; it is
    zero for a text without any. Null texts are encoded as empty ones.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encode = load()

        def predict(values: np.ndarray) -> np.ndarray:
            vectors, mask = encode(values.tolist())
            kept = mask[..., None].astype(np.float64)
            mean = (vectors * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1.0)
            return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)

        return predict

    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    plain = F.coalesce(text, F.lit(""))
    return texts.select(key, F.sha2(plain, 256).alias("hash"), F.lit(model).alias("model"), run(plain).alias("embedding"))


def embed_by_hashing(texts: DataFrame, key: str, text: str = "text", size: int = 64) -> DataFrame:
    """(key, hash, model, embedding): a vector of signed word counts at hashed places, at length 1. It stands for a model
    where there is none; those of a model come from embed_text or a table of the same columns."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(values: pd.Series) -> pd.Series:
        import zlib

        def one(t: str | None) -> list[float]:
            v = np.zeros(size, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x80000000 else -1
            return (v / max(1e-12, float(np.linalg.norm(v)))).tolist()

        return values.map(one)

    return texts.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"), F.lit(f"hashed-words-{size}").alias("model"), run(F.col(text)).alias("embedding"))
