"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.session import scratch_folder

#: Fixed value: the blanks that separate words, space and code points 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """Words of ``text`` as UTF-8, A-Z lower-cased; ``bytes`` lower and split know ASCII only, as wanted."""
    return text.encode().lower().split() if text else []


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read on from there."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``; NULL keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def text_tie(text: str) -> Column:
    """Hash that tells rows of one key apart by their text; NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def rows_of(batches: Iterator, *columns: str) -> Iterator[list[tuple]]:
    """Every Arrow batch as a list of tuples of ``columns``."""
    for batch in batches:
        yield list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True))


#: Keys that may be sent to every task; more of them are joined instead.
BROADCAST_KEYS = 500_000


def small_side(keys: DataFrame) -> DataFrame:
    """``keys`` (one narrow row each), marked for broadcast if counting shows that they are few."""
    keys = saved(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, key: str, text: str, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not in ``bad``, a key and a ``text_tie`` each; NULL keys are compared like any other."""
    bad_key, bad_tie = free_names(docs, "_bad", "_tie")
    rows = small_side(bad.toDF(bad_key, bad_tie).distinct())
    return docs.join(rows, F.col(key).cast("long").eqNullSafe(F.col(bad_key)) & (text_tie(text) == F.col(bad_tie)), "left_anti")


def without_keys(docs: DataFrame, key: str, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in the one column of ``bad``; rows with a NULL key stay."""
    (bad_key,) = free_names(docs, "_bad")
    keys = small_side(bad.toDF(bad_key).filter(F.col(bad_key).isNotNull()).distinct())
    return docs.join(keys, F.col(key).cast("long") == F.col(bad_key), "left_anti")
