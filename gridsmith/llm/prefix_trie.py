"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

Conversations are rows of turn digests, range-partitioned and sorted, so those
that share a prefix stand side by side. In a partition the edges between
neighbours, weighted by their common prefix, are taken in descending depth: a
merge of two components is a branching node, and the nodes between a component
and its next merge are a path without branches. Nodes that begin the first or the
last conversation of a partition may go on next door: they stay open, and the
partition is contracted to these two spines. Spines of neighbouring partitions
are merged in the same way, a few partitions at a time, until one forest is left.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import saved, small_side

#: Bytes of a turn's digest.
DIGEST = 16
#: Partitions, then groups of them, whose spines are merged at once.
FAN = 32
#: Characters of a piece of the list of conversations that end at an open node.
PIECE = 16_384
NOBODY = 2**63 - 1
EMPTY = sha256(b"").hexdigest()

NODE, SPINE, ENDS = 0, 1, 2
_ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
_SPINE = "part int, side int, path binary, chars array<long>, n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>"
SCHEMA = f"kind int, {_ROW}, {_SPINE}, piece int, ids string"


def paths(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, path, chars``: each conversation's turn digests, one behind the other, and the code points of its texts."""
    own_role, own_text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    told = F.concat(F.char_length(own_role).cast("string"), F.lit(":"), own_role, own_text)
    flat = turns.select(
        F.col(key).cast("long").alias("conv"),
        F.struct(
            F.col(turn).alias("turn"), own_role.alias("role"), F.substring(F.sha2(told, 256), 1, 2 * DIGEST).alias("digest"),
            F.char_length(own_text).cast("long").alias("chars"),
        ).alias("t"),
    ).filter("conv is not null")
    return flat.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are replaced by those of the conversation at the last multiple of ``every``; h is crc32(key) modulo ``most``."""
    heads = own.filter(F.col("conv") % every == 0).select(F.col("conv").alias("_donor"), F.slice("turns", 1, most - 1).alias("_head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    joined = own.withColumn("_donor", F.col("conv") - F.col("conv") % every).join(heads, "_donor", "left").withColumn("_h", h)
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return joined.select("conv", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


class _Part:
    """A component: items ``first`` to ``last``, whose nodes deeper than ``depth`` are closed or left open for good."""

    __slots__ = ("first", "last", "depth", "sums", "waiting")

    def __init__(self, at, item):
        self.first = self.last = at
        self.depth = len(item[0]) // DIGEST
        self.sums = item[2]  # per depth: members, smallest member, closed children, leaves and savings below those
        self.waiting = []  # closed children whose parent is the node at ``depth``


def _common(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    at = 0
    while a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of every prefix of ``path``, the empty one first."""
    state = blake2b(digest_size=16)
    keys = [state.digest()]
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        keys.append(state.digest())
    return keys


def merge(items: list, names: list | None, whole: bool) -> tuple[list, list, list]:
    """Nodes, spines and lists of ends of sorted neighbours ``(path, chars, sums)``.

    ``names`` are the members of single conversations; None for items that are
    spines. If ``whole``, nothing lies beyond the items and every node closes.
    """
    nodes, ends = [], []
    keys = {}
    end = len(items) - 1
    spines = {side: (items[at], [[0] * (len(items[at][0]) // DIGEST + 1) for _ in range(5)]) for side, at in ((0, 0), (1, end))}
    for _, sums in spines.values():
        sums[1] = [NOBODY] * len(sums[1])

    def key(at, depth):
        if at not in keys:
            keys[at] = prefix_keys(items[at][0])
        return keys[at][depth]

    def ending(part, depth):
        """Members that end at this node: as shorter paths sort first, they open the component."""
        path, stop = items[part.first][0], part.first
        if names is None or len(path) != depth * DIGEST:
            return []
        while stop <= part.last and items[stop][0] == path:
            stop += 1
        return names[part.first : stop]

    def leave_open(part, depth):
        side, at = (0, 0) if part.first == 0 else (1, end)
        for row in part.waiting:
            nodes[row][9] = key(at, depth)
        part.waiting = []
        for total, sums in zip(spines[side][1], part.sums, strict=True):
            total[depth] = sums.pop()
        ids, piece = ending(part, depth), 0
        per = max(1, PIECE // 21)
        for begin in range(0, len(ids), per):
            ends.append((key(at, depth), piece, ",".join(map(str, ids[begin : begin + per]))))
            piece += 1

    def close(part, depth):
        n, low, kids, leaves, savings = (s.pop() for s in part.sums)
        at = part.first
        savings += (n - 1) * (items[at][1][depth - 1] if depth else 0)
        leaves = leaves if kids else 1
        for row in part.waiting:
            nodes[row][2] = low
        ids = None if names is None else ending(part, depth)
        told = None if ids is None else sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else EMPTY
        part.waiting = [len(nodes)]
        nodes.append([low, depth, None, n, kids, leaves, savings, told, key(at, depth) if names is None else None, None])
        if depth:
            for s, more in zip(part.sums[2:], (1, leaves, savings), strict=True):
                s[depth - 1] += more

    def climb(part, depth):
        is_open = not whole and (part.first == 0 or part.last == end)
        while part.depth > depth:
            (leave_open if is_open else close)(part, part.depth)
            part.depth -= 1

    parts = [_Part(at, item) for at, item in enumerate(items)]
    root = list(range(len(items)))

    def find(at):
        while root[at] != at:
            root[at] = root[root[at]]
            at = root[at]
        return at

    depths = [_common(a[0], b[0]) for a, b in zip(items, items[1:], strict=False)]
    for edge in sorted(range(len(depths)), key=lambda e: -depths[e]):
        depth, a, b = depths[edge], find(edge), find(edge + 1)
        left, right = parts[a], parts[b]
        climb(left, depth)
        climb(right, depth)
        for i, (x, y) in enumerate(zip(left.sums, right.sums, strict=True)):
            left.sums[i] = list(map(min if i == 1 else int.__add__, x, y))
        left.last = right.last
        more, less = sorted((left.waiting, right.waiting), key=len, reverse=True)
        more.extend(less)
        left.waiting = more
        root[b] = a
        parts[b] = None
    rest = parts[find(0)]
    climb(rest, 0)
    (close if whole else leave_open)(rest, 0)
    if whole:
        return nodes, [], ends
    same = end == 0 or items[0][0] == items[end][0]
    return nodes, [(0, *spines[0])] if same else [(0, *spines[0]), (1, *spines[1])], ends


def _table(part: int, nodes: list, spines: list, ends: list):
    """The three kinds of rows as one Arrow table."""
    import pyarrow as pa

    longs, whole = pa.list_(pa.int64()), pa.int64()
    fields = [("kind", pa.int32())] + [(n, whole) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    fields += [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("part", pa.int32()), ("side", pa.int32()), ("path", pa.binary())]
    fields += [(n, longs) for n in ("chars", "n", "low", "kids", "leaves", "saved")] + [("piece", pa.int32()), ("ids", pa.string())]
    none = [None] * (len(fields) - 11)
    rows = [[NODE, *n, *none] for n in nodes]
    rows += [[SPINE, *[None] * 10, part, side, item[0], item[1], *sums, None, None] for side, item, sums in spines]
    rows += [[ENDS, *[None] * 8, k, None, part, *[None] * 8, piece, ids] for k, piece, ids in ends]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _first_forests(sequences: DataFrame) -> DataFrame:
    """Closed nodes, spines and open ends of every range of the sorted conversations."""

    def run(batches):
        from pyspark import TaskContext

        items, names = [], []
        for batch in batches:
            for conv, path, chars in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = len(chars) + 1
                items.append((path, chars, [[1] * size, [conv] * size, [0] * size, [0] * size, [0] * size]))
                names.append(conv)
        if items:
            yield from _table(TaskContext.get().partitionId(), *merge(items, names, False)).to_batches(10_000)

    ranged = sequences.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    return saved(ranged.select("conv", "path", "chars").mapInArrow(run, SCHEMA))


def _contracted(spines: DataFrame, whole: bool) -> DataFrame:
    """The forests of ``FAN`` neighbours as one: what closes, and the two spines that are left."""

    def run(table):
        columns = ("part", "side", "path", "chars", "n", "low", "kids", "leaves", "saved")
        rows = sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True), key=lambda r: r[:2])
        items = [(r[2], r[3], [list(x) for x in r[4:]]) for r in rows]
        return _table(rows[0][0] // FAN, *merge(items, None, whole))

    return saved(spines.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(run, SCHEMA))


def _digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: a digest of the joined pieces, read one after the other."""

    def run(batches):
        import pyarrow as pa

        now, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        yield done()
                    now, state = key, sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            yield done()

    ordered = ends.select("key", "part", "piece", "ids").repartition("key").sortWithinPartitions("key", "part", "piece")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences ``conv, turns`` (distinct keys; turns of ``digest, chars``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. A sequence
    without turns is a member of the root. No sequences give no rows. A
    sequence's digests (16 bytes for each turn) and a partition's share of them
    are held in one task; texts never are.
    """
    joined = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    # Written once, as ranges are drawn from a sample first.
    flat = saved(sequences.select("conv", F.unhex(joined).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")))
    made = _first_forests(flat)
    closed, ends = made.filter(F.col("kind") == NODE), made.filter(F.col("kind") == ENDS)
    spines = made.filter(F.col("kind") == SPINE)
    parts = spines.agg(F.max("part")).first()[0]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if parts is None:
        return closed.select(*columns)
    late = None
    while True:
        groups = parts // FAN
        made = _contracted(spines, groups == 0)
        nodes = made.filter(F.col("kind") == NODE)
        late = nodes if late is None else late.unionByName(nodes)
        if groups == 0:
            break
        spines, parts = made.filter(F.col("kind") == SPINE), groups
    # Nodes that were open once are named by their digest: their ends and their children's parents are joined in.
    late = saved(late.drop("ends_sha256").join(_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    every = closed.select(*columns, "parent_key").unionByName(late.select(*columns, "parent_key"))
    parents = small_side(late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    apart = every.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_parent"))
    return every.filter("parent_key is null").select(*columns).unionByName(apart.select(*columns))


def conversation_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 100, most: int = 6) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``turns``, see ``prefix_trie`` and ``with_shared_heads``.

    Turns follow by number, NULL first, ties by role and then by digest; a NULL
    role or text is the empty one; repeated rows are turns of their own; rows
    with a NULL key belong to no conversation and are left out. Other columns
    are not read.
    """
    return prefix_trie(with_shared_heads(paths(turns, key, turn, role, text), every, most))
