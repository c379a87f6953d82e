"""A Bloom filter as a literal: drops keys that a table cannot hold before they are shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of the largest filter, 1 MB; a longer table only raises the share of keys that pass in vain
MOST_BITS = 1 << 23
_HASHES = 3


@dataclass(frozen=True)
class Bloom:
    """``has(sql)`` is SQL that holds for every key of the table, and for few others."""

    literal: str
    bits: int

    def has(self, key: str) -> str:
        at = [f"(xxhash64({key}, {i}) & {self.bits - 1}L)" for i in range(_HASHES)]
        return "(" + " AND ".join(f"getbit(get({self.literal}, CAST(shiftright({p}, 6) AS INT)), CAST({p} & 63L AS INT)) = 1" for p in at) + ")"


def bloom_of(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> Bloom:
    """The filter of a table's keys. Its words are or-ed by tasks; the driver gets ``most_bits / 64`` numbers at most."""
    n = keys.count()
    bits = 64
    while bits < min(16 * n, most_bits):
        bits *= 2
    places = ", ".join(f"xxhash64(`{key}`, {i}) & {bits - 1}L" for i in range(_HASHES))
    set_ = keys.selectExpr(f"explode(array({places})) AS p").selectExpr("CAST(shiftright(p, 6) AS INT) AS word", "shiftleft(1L, CAST(p & 63L AS INT)) AS bit")
    words = {r["word"]: r["bits"] for r in set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}
    text = ",".join(str(words.get(i, 0)) for i in range(bits // 64))
    return Bloom(f"CAST(split('{text}', ',') AS array<bigint>)", bits)
