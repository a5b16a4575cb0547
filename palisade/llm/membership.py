"""A fixed-size bitmap of keys, tested inside the JVM: rows that can't meet any of the keys need not be shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits; the broadcast table has at most one row for each, about 3 MB.
WORDS = 1 << 16
#: The column that ``maybe_in`` adds. Names that begin like this one are the operators' own.
MAYBE = "_palisade_maybe"


def maybe_in(rows: DataFrame, keys: DataFrame, column: str, words: int = WORDS) -> DataFrame:
    """Add ``MAYBE``: false only where no key equals the row's 64-bit ``column``. Keys are reduced to bits where they
    are, so only the bitmap is sent, whose size doesn't depend on the data; a full one lets everything pass."""
    word, bit = f"pmod(shiftright({column}, 6), {words})", f"cast(pmod({column}, 64) as int)"
    bits = keys.selectExpr(f"{word} as _palisade_word", f"shiftleft(1L, {bit}) as _palisade_bit").groupBy("_palisade_word").agg(F.bit_or("_palisade_bit").alias("_palisade_bits"))
    joined = rows.withColumn("_palisade_word", F.expr(word)).join(F.broadcast(bits), "_palisade_word", "left")
    return joined.withColumn(MAYBE, F.expr(f"coalesce((shiftright(_palisade_bits, {bit}) & 1L) = 1L, false)")).drop("_palisade_word", "_palisade_bits")
