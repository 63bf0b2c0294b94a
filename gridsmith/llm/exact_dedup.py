"""Exact duplicates, found in three steps that all compare the whole content.

A task first merges equal texts among its own rows. The local winners are merged
per digest and salt, so that even a digest held by every task is dealt over
several tasks, and the winners of the salts are merged last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import BLANKS, free_names, saved, small_side, without_keys

SALTS = 8
#: A task hands its local groups on when their texts or rows exceed these.
LOCAL_BYTES = 64_000_000
LOCAL_ROWS = 200_000

_LOCAL = (
    "lid long, salt int, route binary, blob binary, text_sha256 string, n long, best long, best_at int, size long, members array<long>"
)


def _sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[bytes], bytes] = _sha256,
    local_bytes: int = LOCAL_BYTES, local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without their blanks; NULL counts as
    the empty text. The row with the most code points stays, then the smallest
    key (NULL keys last), then the row met first, so of repeated rows exactly
    one is kept. ``digest`` only routes: texts are equal when their content is,
    whatever the digest says. Other columns are ignored; no rows give no rows.
    """

    def local(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        first = TaskContext.get().partitionId() << 32
        given = held = rows = 0
        groups: dict[bytes, list[list]] = {}

        def flush():
            nonlocal given, held, rows, groups
            out = []
            for route, chain in groups.items():
                for norm, n, best, at, members in chain:
                    blob = pack.compress(norm)
                    out.append((first + given, ((first >> 32) + given) % salts, route, blob, hashlib.sha256(norm).hexdigest(), n, best, at, len(members), members))
                    given += 1
            held, rows, groups = 0, 0, {}
            for start in range(0, len(out), 2000):
                part = out[start : start + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

        names = ["lid", "salt", "route", "blob", "text_sha256", "n", "best", "best_at", "size", "members"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or ""
                norm = body.encode().translate(None, BLANKS)
                chain = groups.setdefault(digest(norm), [])
                rank = (-len(body), doc is None, doc or 0)
                for group in chain:
                    if group[0] == norm:
                        if rank < (-group[1], group[2] is None, group[2] or 0):
                            group[1:4] = len(body), doc, len(group[4])
                        group[4].append(doc)
                        break
                else:
                    chain.append([norm, len(body), doc, 0, [doc]])
                    held += len(norm)
                rows += 1
                if held > local_bytes or rows > local_rows:
                    yield from flush()
        yield from flush()

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = saved(own.mapInArrow(local, _LOCAL))
    order = [F.desc("n"), F.asc_nulls_last("best"), F.asc("lid")]

    # A digest of one local group has nothing to be compared with, so its content is not moved.
    met = small_side(groups.groupBy("route").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("route"))
    alone = groups.select("route", "lid", "best", "best_at", "size").join(met, "route", "left_anti").select(
        "lid", F.struct("lid", "best", "best_at").alias("keep"), F.col("size").alias("group_size")
    )
    same = Window.partitionBy("route", "salt", "blob").orderBy(*order)
    salted = groups.join(met, "route", "left_semi").select("route", "salt", "blob", "n", "best", "best_at", "lid", "size").withColumns({
        "place": F.row_number().over(same), "salt_lid": F.first("lid").over(same),
        "salt_size": F.sum("size").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    every = Window.partitionBy("route", "blob").orderBy(*order)
    final = salted.filter("place = 1").select("route", "blob", "n", "best", "best_at", "lid", "salt_size").withColumns({
        "keep": F.first(F.struct("lid", "best", "best_at")).over(every),
        "group_size": F.sum("salt_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).select(F.col("lid").alias("salt_lid"), "keep", "group_size")
    # From here on references only: a text of thousands of rows is not moved again.
    links = alone.unionByName(salted.select("lid", "salt_lid").join(final, "salt_lid").drop("salt_lid"))
    rows = groups.select("lid", "text_sha256", "members").join(links, "lid").select(
        "lid", "text_sha256", "keep", "group_size", F.posexplode("members").alias("at", "doc_id")
    )
    return rows.select(
        "doc_id", F.col("keep.best").alias("keep_id"), "group_size",
        ((F.col("lid") == F.col("keep.lid")) & (F.col("at") == F.col("keep.best_at"))).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, as ``exact_groups`` chooses it, with all its columns.

    Rows that share a key are told apart by their text; of rows alike in both one
    stays, and NULL keys count as one key. NULL and empty texts are equal; an
    empty table gives no rows; other columns may have any names.
    """
    found = saved(exact_groups(docs, key, text).select("doc_id", "kept", "text_sha256"))
    mixed = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or doc_id is null").select("doc_id")
    dropped = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    if mixed.isEmpty():
        return without_keys(docs, key, dropped)
    # Helper columns take names that are no columns of the table.
    name, sha, place = free_names(docs, "_key", "_sha", "_place")
    doubtful = saved(mixed.select(F.col("doc_id").alias(name)))
    own = F.col(key).cast("long").eqNullSafe(F.col(name))
    clear = without_keys(docs.join(doubtful, own, "left_anti"), key, dropped)
    kept = found.filter("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(f"{sha}_kept"))
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    order = Window.partitionBy(key, sha).orderBy(F.desc_nulls_last(F.char_length(text)))
    rest = docs.join(doubtful, own, "left_semi").withColumn(sha, digest).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    chosen = rest.join(kept, own & (F.col(sha) == F.col(f"{sha}_kept")), "left_semi").drop(sha, place)
    return clear.unionByName(chosen)
