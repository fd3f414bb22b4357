"""Hashed character-trigram embeddings of 256 dimensions.

A trigram adds its sign to one dimension: byte 0 of its SHA-256 is the dimension, bit 0 of byte 4 the sign. In hex that is the first
two digits and the tenth. The sums are whole numbers; the vector is divided by its norm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.constants import EMBEDDING_SIZE


def _normal(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    return F.when(t == "", "<empty>").otherwise(F.rpad(t, F.greatest(F.length(t), F.lit(3)), " "))


def sparse_embeddings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, idx, weight)``: the sums by dimension that are not 0. Each text's trigrams are counted before they are hashed."""
    t = rows.select(key, _normal(F.col(text)).alias("t"))
    grams = t.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3)))).alias("gram"))
    counts = grams.groupBy(key, "gram").agg(F.count("*").alias("n")).withColumn("h", F.sha2("gram", 256))
    idx = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    sign = F.when(F.conv(F.substring("h", 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return counts.groupBy(key, idx.alias("idx")).agg(F.sum(sign * F.col("n")).alias("weight")).where("weight <> 0")


def embed_texts(texts: pd.Series) -> pd.Series:
    """Dense unit vectors. A trigram is three code points of 21 bits; the distinct ones of some texts are hashed once."""
    known: dict[int, int] = {}
    out = []
    for some in _chunks(texts):
        codes, of = [], []
        for i, text in enumerate(some):
            t = ((text or "").lower().strip() or "<empty>").ljust(3)
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            codes.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
            of.append(np.full(len(c) - 2, i))
        grams, which = np.unique(np.concatenate(codes), return_inverse=True)
        for g in grams.tolist():
            if g not in known:
                h = hashlib.sha256("".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))).encode("utf-8", "surrogatepass")).digest()
                known[g] = h[0] if h[4] & 1 else -h[0] - 1
        place = np.fromiter(map(known.__getitem__, grams.tolist()), np.int64, len(grams))[which]
        at, sign = np.where(place < 0, -place - 1, place), np.where(place < 0, -1.0, 1.0)
        v = np.bincount(np.concatenate(of) * EMBEDDING_SIZE + at, weights=sign, minlength=len(some) * EMBEDDING_SIZE).reshape(len(some), EMBEDDING_SIZE)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out += list((v / np.where(norm > 0, norm, 1.0)).astype(np.float32))
        if len(known) > 1_000_000:
            known.clear()
    return pd.Series(out, index=texts.index, dtype=object)


def _chunks(texts: pd.Series, most: int = 500_000) -> Iterator[list[str | None]]:
    """Texts of about ``most`` characters together, so that the arrays stay small."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text or "")
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def embed(text: Column) -> Column:
    return F.pandas_udf(embed_texts, "array<float>")(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
