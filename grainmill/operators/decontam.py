"""Decontamination by shared word grams and short exact texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import text as T

#: Words of a gram; shorter protected texts, of this many words at least, must be equal as a whole.
WIDTH, LEAST_EXACT = 13, 4
CJK_WIDTH, CJK_LEAST = 32, 8
#: Keys of an index that go to every worker (about 10 MB); a larger one is joined.
MOST_KEYS = 1 << 17


def gram_index(protected: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct keys of protected texts: word grams, whole short texts and windows of CJK characters; ``kind`` tells them apart."""
    w = protected.select(T.words(text_col).alias("w"), F.col(text_col).alias("t"))
    grams = w.select(F.lit("gram").alias("kind"), F.explode(T.ngrams("w", width)).alias("key"))
    exact = w.where(F.size("w").between(LEAST_EXACT, width - 1)).select(F.lit("exact").alias("kind"), F.array_join("w", " ").alias("key"))
    cjk = w.select(F.lit("cjk").alias("kind"), F.explode(T.cjk_grams("t", CJK_WIDTH, CJK_LEAST)).alias("key"))
    return grams.unionByName(exact).unionByName(cjk).distinct()


def hits(docs: DataFrame, index: DataFrame, id_col: str, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Ids of documents that share a key with the index; null texts share none.

    The index is read here. Of at most ``MOST_KEYS`` keys it is sent along and documents are looked up in their
    rows, without a shuffle of their grams; else see ``joined_hits``.
    """
    keys = index.select("kind", "key").limit(MOST_KEYS + 1).collect()
    if len(keys) > MOST_KEYS:
        return joined_hits(docs, index, id_col, text_col, width)
    of = {kind: frozenset(k.key for k in keys if k.kind == kind) for kind in ("gram", "exact", "cjk")}
    long, short, cjk, least, window = of["gram"], of["exact"], of["cjk"], LEAST_EXACT, CJK_WIDTH

    def one(joined: str | None) -> bool:
        if not joined:
            return False
        w = joined.split(" ")
        if len(w) >= width:
            if any(" ".join(w[i : i + width]) in long for i in range(len(w) - width + 1)):
                return True
        elif len(w) >= least and joined in short:
            return True
        whole = "".join(w) if cjk else ""
        return any(whole[i : i + window] in cjk for i in range(len(whole) - window + 1))

    @F.pandas_udf("boolean")
    def shares(joined: pd.Series) -> pd.Series:
        return joined.map(one).astype(bool)

    return docs.where(shares(F.array_join(T.words(text_col), " "))).select(F.col(id_col).alias("id")).distinct()


def joined_hits(docs: DataFrame, index: DataFrame, id_col: str, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The same for an index of any size.

    Keys of documents are hashed before the semi join, so the shuffle moves eight
    bytes a gram; the few that meet are joined again on the key itself.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        w = rows.select("id", F.col("t"), T.words("t").alias("w"))
        exact = F.when(F.size("w").between(LEAST_EXACT, width - 1), F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
        parts = [_tagged(kind, keys) for kind, keys in (("gram", T.ngrams("w", width)), ("exact", exact), ("cjk", T.cjk_grams("t", CJK_WIDTH, CJK_LEAST)))]
        return w.select("id", F.explode(F.concat(*parts)).alias("k")).select("id", "k.*")

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    hashed = F.xxhash64("kind", "key").alias("h")
    near = keyed(d).select("id", hashed).join(index.select(hashed), "h", "left_semi").select("id").distinct()
    return keyed(d.join(near, "id", "left_semi")).join(index, ["kind", "key"], "left_semi").select("id").distinct()


def _tagged(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def decontaminate(docs: DataFrame, index: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Documents without a hit."""
    return docs.join(hits(docs, index, id_col, text_col).withColumnRenamed("id", id_col), id_col, "left_anti")
