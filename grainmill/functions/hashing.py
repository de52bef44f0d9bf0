"""Content identities and hash-derived choices."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grainmill.functions.text import fold

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha(*parts: Col) -> Column:
    """SHA-256 of parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[_c(p) for p in parts]), 256)


def dedup_key(state: Col, instruction: Col, candidates: Col) -> Column:
    """Identity of a question: state, instruction and the sorted (not distinct) candidates, all folded."""
    options = F.array_join(F.array_sort(F.transform(_c(candidates), fold)), "\x1e")
    return F.sha2(F.concat_ws("\x1f", fold(state), fold(instruction), options), 256)


def state_cache_key(state: Col, *versions: str) -> Column:
    """Identity of a prepared state: its text and the versions of what prepares it."""
    return F.sha2(F.concat_ws("\x1f", _c(state), *[F.lit(v) for v in versions]), 256)


def unit_fraction(key: Col) -> Column:
    """SHA-256's first four bytes, least significant first, as a share of 2^32 - 1."""
    h = F.sha2(_c(key), 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long") / 4294967295.0


def bucket(key: Col, n: int = 100) -> Column:
    """SHA-256's first eight hex digits modulo n."""
    return (F.conv(F.substring(F.sha2(_c(key), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def role_of(weights: dict[str, int]):
    """An Arrow UDF that picks a role by the whole 256-bit hash modulo the sum of weights."""
    names, total = list(weights.items()), sum(weights.values())

    @F.pandas_udf(StringType())
    def pick(key: pd.Series) -> pd.Series:
        def one(k: str) -> str:
            at = int(hashlib.sha256(k.encode()).hexdigest(), 16) % total
            for name, weight in names:
                if at < weight:
                    return name
                at -= weight
            raise AssertionError

        return key.map(one)

    return pick


def hashed_order(seed: int | str, *key: Col) -> Column:
    """A keyed pseudo-random order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in key]), 256)


def negative_label(label: Col, k: Col, seed: Col) -> Column:
    """A wrong label of k, by a hash seed: (label + 1 + seed mod (k-1)) mod k."""
    return (_c(label) + 1 + F.pmod(_c(seed), _c(k) - 1)) % _c(k)
