"""SimHash near duplicates with pivot distance tables.

Fingerprints that may lie within ``radius`` bits share some blocks of bits
(pigeonhole), so only rows of one block key are compared. Inside a key every
fingerprint has its Hamming distances to many reference fingerprints; a pair
whose distances to any reference differ by more than the radius is discarded
(triangle inequality), and the survivors are verified bit by bit. Each key
returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from itertools import combinations, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import saved, small_side, text_tie, without_rows, words_of
from gridsmith.operators.density import connected_components

RADIUS = 4
WIDTH = 4
#: Blocks the 64 bits are cut into, and how many of them a key joins: radius + joined blocks.
BLOCKS = 6
PIVOTS = 24
#: Rows of one key that are compared at once; a larger key is compared tile by tile.
TILE = 4096


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words joined by a blank, repeats included; fewer words give their whole sequence."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _digests(words: list[bytes], width: int, repeats: bool = True):
    """XXH64 values of the shingles, as ``shingles`` gives them, in one big-endian array."""
    import numpy as np
    import xxhash

    found = shingles(words, width) if len(words) <= width else map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, found if repeats else set(found), repeat(42))), dtype=">u8")


def fingerprint(text: str | None, width: int = WIDTH, repeats: bool = True) -> int:
    """64 bits, each set if it is set in over half the XXH64 values of the shingles; no word gives zero.

    Without ``repeats`` a shingle that occurs again does not count again.
    """
    return _fingerprint(words_of(text), width, repeats)


def _fingerprint(words: list[bytes], width: int = WIDTH, repeats: bool = True) -> int:
    import numpy as np

    values = _digests(words, width, repeats)
    if not len(values):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(values), 65_536):
        part = values[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, repeats: bool = True) -> DataFrame:
    """``doc_id, bits``: the fingerprint of every row as a signed long. NULL texts count as empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), width, repeats) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, bits long")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of all choices of ``blocks - radius`` blocks: two values within ``radius`` bits agree under one of them."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(whole, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """``a, b``: links among the distinct fingerprints ``bits`` that connect the same rows as all links do."""
    return _compared(distinct, block_masks(radius, blocks), radius, pivots, tile)


def _compared(distinct: DataFrame, masks: list[int], radius: int, pivots: int, tile: int) -> DataFrame:
    """Pairs ``a, b`` within ``radius`` among the rows of one masked value: a spanning forest."""
    masks = [_signed(m) for m in masks]
    keyed = distinct.select(
        "bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("table", "block")
    )
    # Keys with one row have no pair. The counts are summed before the shuffle.
    shared = keyed.groupBy("table", "block").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    met = keyed.join(shared, ["table", "block"])
    # A large key is dealt into tiles of bounded size, and each two tiles meet once.
    tiles = F.greatest(F.ceil(F.col("rows") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("bits"), tiles).cast("int")
    other = F.explode(F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1)))
    dealt = met.select("bits", "table", "block", own.alias("own"), other.alias("other")).select(
        "bits", "table", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
    )
    cell = ["table", "block", "low", "high"]
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, "bits")

    def run(batches):
        import numpy as np

        rest = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            change = np.ones(len(part[0]), dtype=bool)
            change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in part[1:]])
            last = int(np.flatnonzero(change)[-1])
            rest = [x[last:] for x in part]
            if last:
                yield from forest(part[0][:last], np.cumsum(change[:last]))
        if rest is not None:
            yield from forest(rest[0], np.zeros(len(rest[0]), dtype=np.int64))

    def forest(bits, cells):
        import numpy as np
        import pyarrow as pa

        bits = bits.view(np.uint64)
        points = np.random.default_rng(64).integers(0, 2**64, size=pivots, dtype=np.uint64)
        table = np.bitwise_count(bits[:, None] ^ points).astype(np.int8)
        rows = np.arange(len(bits))
        root = rows.copy()
        gap = 1
        while gap < len(bits):
            left = np.flatnonzero(cells[:-gap] == cells[gap:])
            if not len(left):
                break
            # Pairs that hang together already need no look.
            left = left[root[left] != root[left + gap]]
            for at in range(0, pivots, 8):
                far = np.abs(table[left, at : at + 8] - table[left + gap, at : at + 8]).max(axis=1, initial=0)
                left = left[far <= radius]
            apart = np.bitwise_count(bits[left] ^ bits[left + gap])
            left = left[apart <= radius]
            if len(left):
                _join(root, left, left + gap)
            gap += 1
        moved = np.flatnonzero(root != rows)
        if len(moved):
            a, b = bits[root[moved]].view(np.int64), bits[moved].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _join(root, a, b) -> None:
    """Give the rows at ``a`` and ``b`` one root, the smallest row, and let every row point at its root."""
    import numpy as np

    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root[:] = up


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id, component_size``.

    Rows link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest key reachable. Texts without a word have
    fingerprint zero and link like any other; a NULL text counts as empty; rows
    with a NULL key join in but never name a component unless all do.
    """
    own = saved(fingerprints(docs, key, text, width))
    distinct = own.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    found = saved(links(distinct.select("bits"), radius, blocks))
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Only linked fingerprints take part in the rounds.
    reached = connected_components(nodes, found).select(F.col("node").alias("bits"), F.col("component").alias("root"))
    named = distinct.join(reached, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("component_size"))
    by_bits = named.select("bits", "root").join(names, "root").drop("root")
    return own.join(by_bits, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )


#: Near copies by shingles: five words, and this similarity of the sets of shingles.
NEAR_WIDTH, SIMILARITY = 5, 0.8
#: Texts drawn to learn which shingles are common, and how many of those are told to every task. They only balance the work.
COMMON_TEXTS, COMMON = 20_000, 200_000
#: Sets of shingles that a task keeps while it verifies pairs.
HELD = 64
#: 64-bit words of the parity sketch of a set; two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 16

_SET = "doc_id long, tie long, node long, bits long, size int, sketch binary, rare array<long>"


def _marks(words: list[bytes], width: int):
    """The different shingles of a text's ``words`` as ascending 64-bit hashes."""
    import numpy as np

    return np.unique(_digests(words, width).astype(np.uint64))


def _node(marks) -> int:
    """One name for all texts with the same set of shingles."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(marks.tobytes(), 7))


def shingle_sets(docs: DataFrame, width: int = NEAR_WIDTH) -> DataFrame:
    """``node, marks`` of every row of ``doc_id, text``: the name of its set and the hashes of its different shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            marks = [_marks(words_of(t.as_py()), width) for t in batch.column(0)]
            nodes = pa.array([_node(m) for m in marks], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([m.view(np.int64) for m in marks], pa.list_(pa.int64()))], ["node", "marks"])

    return docs.select("text").mapInArrow(run, "node long, marks array<long>")


def common_marks(own: DataFrame, width: int, texts: int = COMMON_TEXTS, limit: int = COMMON) -> list[tuple[int, int]]:
    """Shingles that a hash sample of about ``texts`` rows of ``doc_id, tie, text`` has more than once, with their counts, the most common first."""
    n = own.count()
    drawn = own.filter(F.pmod(F.xxhash64("doc_id", "tie", F.lit(5)), F.lit(1_000_000)) < 1_000_000 * min(1.0, texts / max(1, n)))
    seen = shingle_sets(drawn, width).select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    return [(r.mark, r.n) for r in seen.filter("n > 1").orderBy(F.desc("n"), "mark").limit(limit).collect()]


def prefix_sets(own: DataFrame, width: int, similarity: float, common: list[tuple[int, int]], printed: bool = False) -> DataFrame:
    """Each row of ``doc_id, tie, text`` with the name, size and sketch of its set and its rarest shingles; if ``printed``, its fingerprint too.

    Two sets that are at least ``similarity`` alike share one of those: they are
    one more than a set can lack of another that is so similar, in one order for all.
    """
    shared = own.sparkSession.sparkContext.broadcast(sorted(common))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = np.array([m for m, _ in shared.value], dtype=np.int64)
        times = np.array([n for _, n in shared.value] + [0], dtype=np.int64)
        for batch in batches:
            out = []
            for text in batch.column(2):
                words = words_of(text.as_py())
                marks = _marks(words, width)
                n = len(marks)
                signed = marks.view(np.int64)
                at = np.searchsorted(known, signed)
                if len(known):
                    at[known[np.minimum(at, len(known) - 1)] != signed] = len(known)
                rarest = np.lexsort((signed, times[at]))[: n - math.ceil(similarity * n - 1e-6) + 1 if n else 0]
                parity = np.bincount((marks >> np.uint64(54)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
                bits = _signed(_fingerprint(words)) if printed else None
                out.append((_node(marks), bits, n, np.packbits(parity.astype(np.uint8)).tobytes(), signed[rarest]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))],
                ["doc_id", "tie", "node", "bits", "size", "sketch", "rare"],
            )

    return own.select("doc_id", "tie", "text").mapInArrow(run, _SET)


def _proposed(cells: DataFrame, sets: DataFrame, named: DataFrame | None, similarity: float, tile: int, every: bool) -> DataFrame:
    """``a, b``: pairs of one cell and of two components that their sketches allow to be similar.

    All of them with ``every``, else those of each row with its nearest one of
    another component, for every cell. ``named`` has the components so far.
    """
    rows = sets.select("node", "size", "sketch")
    if named is None:
        placed = cells.withColumn("component", F.col("node"))
    else:
        placed = cells.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Cells that hang together already need no look.
    mixed = placed.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
    met = placed.join(mixed.filter("low < high").select("mark", "rows"), "mark").join(rows, "node")
    # A large cell is dealt into tiles of bounded size, and each two tiles meet once.
    tiles = F.greatest(F.ceil(F.col("rows") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    other = F.explode(F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1)))
    kept = ["mark", "node", "component", "size", "sketch"]
    dealt = met.select(*kept, own.alias("own"), other.alias("other")).select(
        "mark", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *kept[1:]
    )
    cell = ["mark", "low", "high"]
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, "node")

    def run(batches):
        import numpy as np

        rest = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            part.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH))
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            change = np.ones(len(part[0]), dtype=bool)
            change[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in part[:3]])
            last = int(np.flatnonzero(change)[-1])
            rest = [x[last:] for x in part]
            if last:
                yield from near(np.cumsum(change[:last]), *[x[:last] for x in part[3:]])
        if rest is not None:
            yield from near(np.zeros(len(rest[0]), dtype=np.int64), *rest[3:])

    def near(cells, node, component, size, sketch):
        import numpy as np
        import pyarrow as pa

        rows = np.arange(len(node))
        mate, least = rows.copy(), np.full(len(node), 64 * SKETCH + 1)
        gap = 1
        while gap < len(node):
            left = np.flatnonzero(cells[:-gap] == cells[gap:])
            if not len(left):
                break
            left = left[component[left] != component[left + gap]]
            small, large = np.minimum(size[left], size[left + gap]), np.maximum(size[left], size[left + gap])
            left = left[small >= similarity * large - 1e-6]
            # So many shingles may lie in one of the two sets alone.
            both = size[left].astype(np.int64) + size[left + gap]
            most = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-6).astype(np.int64)
            apart = np.zeros(len(left), dtype=np.int64)
            for at in range(0, SKETCH, 4):
                apart = apart + np.bitwise_count(sketch[left, at : at + 4] ^ sketch[left + gap, at : at + 4]).sum(axis=1, dtype=np.int64)
                close = apart <= most
                left, most, apart = left[close], most[close], apart[close]
            if every:
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[left], node[left + gap])), pa.array(np.maximum(node[left], node[left + gap]))], ["a", "b"])
            else:
                for one, other in ((left, left + gap), (left + gap, left)):
                    closer = apart < least[one]
                    least[one[closer]], mate[one[closer]] = apart[closer], other[closer]
            gap += 1
        moved = np.flatnonzero(mate != rows)
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[mate[moved]], node[moved])), pa.array(np.maximum(node[mate[moved]], node[moved]))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _similar(own: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sets of shingles are similar enough."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = small_side(sets.join(named, "node", "left_semi").select("node", F.col("first.doc_id").alias("_first"), F.col("first.tie").alias("_tie")))
    chosen = own.join(first, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("tie") == F.col("_tie"))).select("node", "text")
    found = saved(_packed_texts(chosen).dropDuplicates(["node"]))
    # Pairs are few bytes but much work, which the planner cannot know: they are dealt to all cores.
    spark = own.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    half = pairs.join(found.withColumnsRenamed({"node": "a", "blob": "p"}), "a").repartition(parts, "b")
    both = half.join(found.withColumnsRenamed({"node": "b", "blob": "q"}).repartition(parts, "b"), "b")

    def run(batches):
        import numpy as np
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        held = OrderedDict()

        def marks(node, blob):
            # A text meets several others one after the other.
            if node in held:
                held.move_to_end(node)
                return held[node]
            found = held[node] = _marks(words_of(open_(blob.as_py()).decode()), width)
            if len(held) > HELD:
                held.popitem(last=False)
            return found

        for batch in batches:
            alike = []
            for a, b, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                one, other = marks(a, p), marks(b, q)
                common = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(common >= similarity * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(np.array(alike, dtype=bool))

    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """``node, blob`` of every row of ``node, text``: the compressed text, which is a fraction of the hashes of its shingles."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            blobs = [press((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "blob"])

    return docs.select("node", "text").mapInArrow(run, "node long, blob binary")


def _cells(sets: DataFrame) -> DataFrame:
    """``node, mark``: the rows of every rare shingle that several have; of shingles with the same rows one stands for all."""
    # Marks are dealt out once, to be counted and to be joined.
    cells = sets.select("node", F.explode("rare").alias("mark")).repartition("mark")
    members = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    shared = cells.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1")
    return cells.join(shared.groupBy("n", "h1", "h2").agg(F.min("mark").alias("mark")).select("mark"), "mark").select("node", "mark")


def _linked_sets(held: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect the sets whose texts' fingerprints hang together by at most ``radius`` bits."""
    placed = held.select("node", "bits").distinct()
    found = saved(links(placed.select("bits").distinct(), radius, radius + BLOCKS - RADIUS))
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reached = connected_components(ends, found).select(F.col("node").alias("bits"), F.col("component").alias("root"))
    rooted = placed.join(reached, "bits", "left").select("node", F.coalesce("root", "bits").alias("root"))
    several = rooted.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    return rooted.join(several, "root").filter("node != a").select("a", F.col("node").alias("b")).distinct()


def near_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY, tile: int = TILE,
    radius: int | None = None,
) -> DataFrame:
    """``doc_id, tie, keep_id, keep_tie`` for the rows that have a near copy; ``tie`` is the hash of the text.

    A pair of texts is one if the sets of their ``width``-word shingles are at
    least ``similarity`` alike (texts without words are alike), and chains of
    pairs are one group; all pairs count. Such sets share one of their rarest
    shingles, so the rows of one of these are a cell. First each row proposes its
    nearest one of another group in every cell, until a round joins nothing;
    then all pairs of different groups are verified that are left. With a ``radius``
    texts whose SimHash fingerprints link within so many bits are near copies too:
    their components come first, and shingles complete them. NULL keys are keys
    like any other, behind all of them; repeated rows share key and text and are
    never copies of themselves.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_tie(text).alias("tie"), F.col(text).cast("string").alias("text"))
    held = saved(prefix_sets(own, width, similarity, common_marks(own, width), radius is not None))
    sets = saved(
        held.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("first"), *[F.first(c).alias(c) for c in ("size", "sketch", "rare")])
    )
    cells = saved(_cells(sets))
    named = None
    if radius is not None:
        linked = saved(_linked_sets(held, radius))
        named = connected_components(linked.select(F.explode(F.array("a", "b")).alias("node")).distinct(), linked)
    every, judged = False, None
    while True:
        pairs = _proposed(cells, sets, named, similarity, tile, every)
        # A pair that was refused is proposed again for as long as its rows are apart, and need not be verified again.
        pairs = saved(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"))
        judged = pairs if judged is None else judged.unionByName(pairs)
        found = saved(_similar(own, sets, pairs, width, similarity))
        new = not found.isEmpty()
        if new or named is None:
            # One link per row stands for all that made its component.
            if named is not None:
                found = found.unionByName(named.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")))
            nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            named = connected_components(nodes, found)
        if every:
            break
        every = not new
    rows = held.select("doc_id", "tie", "node").distinct().join(named, "node", "left").select("doc_id", "tie", F.coalesce("component", "node").alias("group"))
    keeps = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(keeps, "group").select("doc_id", "tie", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tie").alias("keep_tie"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, keep_id`` for the documents that have a near copy: the smallest key that chains of near copies lead to."""
    return near_rows(docs, key, text, **options).select("doc_id", "keep_id").distinct()


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest key, with all its columns.

    NULL keys come behind all others and are dropped like any; rows alike in key
    and text stay together. Texts without a word are alike; an empty table
    gives no rows; other columns may have any names.
    """
    found = near_rows(docs, key, text, **options).filter("not (doc_id <=> keep_id and tie <=> keep_tie)")
    return without_rows(docs, key, text, found.select("doc_id", "tie"))
