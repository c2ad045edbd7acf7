"""What the training-data operators share: words, hashes and tables in the shared folder."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.session import discard, shared_folder, stored  # noqa: F401

#: A-Z to a-z; every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i + 32 * (64 < i < 91) for i in range(256))


class Hashes(dict):
    """64-bit hash of each word (bytes); words seen before come from the dictionary, which is emptied when it grows too large."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: bytes | None, table: bytes | None = None) -> list[bytes]:
    """Words of UTF-8 bytes between ASCII white space (0x20, 0x09-0x0D), after byte translation by ``table``; null has none."""
    if not text:
        return []
    return (text.translate(table) if table else text).split()


def word_hashes(tokens: list[bytes], seen: Hashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
