"""SentencePiece encoding and decoding as joins over a lattice of pieces.

Texts fall into units that no piece reaches across. The bounded-length
substrings of every different unit meet the piece table, which every task has;
the matches are the edges of the unit's lattice, which a fold over an array walks:
Viterbi for unigram models, and for merge models the best-scored merge again and again.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.common import saved

SPACE = "▁"
#: Units up to this many characters are folded as bits of a long; longer ones are encoded one by one.
FOLDED = 60
#: Most frequent units of a sample of texts, whose ids every task gets; all others are joined.
FREQUENT = 200_000
SAMPLE = 20_000
#: Texts of a bucket on average, and the fewest buckets: the units of one are held by a task.
BUCKET_TEXTS, BUCKETS = 2_000, 32
#: Bytes of text whose rare units share a partition: the edges of their lattices stay in a task's memory instead of being spilled.
UNIT_BYTES = 2_000_000
#: Ids that are handed on together: a task never holds those of all its texts.
HANDED_IDS = 300_000


@dataclass
class Pieces:
    """A piece table: texts, scores and kinds by id, as the model file has them."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]  # fixed values: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    unigram: bool = False
    dummy_prefix: bool = True
    usable: dict[str, int] = field(init=False)
    bytes_from: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.usable = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (1, 4)}
        self.bytes_from = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == 6}
        if any(SPACE in t.lstrip(SPACE) for t in self.usable):
            raise ValueError("pieces that reach from one word into the next are not supported")

    @property
    def unknown(self) -> int:
        return self.kinds.index(2)

    def splitter(self) -> re.Pattern:
        """Units: blanks with the word after them; line ends and tabs alone if no longer piece has them."""
        alone = "".join(c for c in "\n\r\t" if not any(c in t and len(t) > 1 for t in self.usable))
        apart = f"|[{re.escape(alone)}]" if alone else ""
        return re.compile(f"{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+{apart}")

    def prepared(self, text: str | None) -> str:
        """The text with visible blanks, and one in front unless it is empty."""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE) if text else ""

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes_from[b] for b in char.encode()] if len(self.bytes_from) == 256 else [self.unknown]

    def written(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = []
        for text, kind in zip(self.texts, self.kinds, strict=True):
            out.append(bytes([int(text[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else text.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: list[int], written: list[bytes]) -> str:
        text = b"".join(written[i] for i in ids).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def read_model(path: str) -> Pieces:
    """The piece table of a SentencePiece model file, read on the driver; only models without text rules are supported."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge models that leave the text as it is are supported")
    return Pieces(
        [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 1, rules.add_dummy_prefix
    )


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, edges``: all matches of pieces in each unit, and every single character, ordered by rank and place; other columns stay.

    Every task has the piece table, so its matches are met inside a unit: one row goes in and out, whatever its length.
    """
    others = [f for f in units.schema.fields if f.name != "unit"]
    shared = units.sparkSession.sparkContext.broadcast(pieces)  # as long as the vocabulary
    longest = max((len(t) for t in pieces.usable), default=1)
    least = min((pieces.scores[i] for i in pieces.usable.values()), default=0.0)

    def run(batches):
        import pyarrow as pa

        table, scores, fallback = shared.value.usable, shared.value.scores, shared.value.fallback
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.float64())
        for batch in batches:
            ends, id_ends, found = [0], [0], [[] for _ in kinds]
            rank, starts, stops, cuts, inner, ids, worth = found
            for unit in batch.column(0).to_pylist():
                n = len(unit)
                for s in range(n):
                    for e in range(s + 1, min(s + longest, n) + 1):
                        at = table.get(unit[s:e])
                        if at is None and e > s + 1:
                            continue
                        score = least - 10.0 if at is None else float(scores[at])
                        ids.extend(fallback(unit[s]) if at is None else (at,))
                        id_ends.append(len(ids))
                        rank.append(-score)
                        starts.append(s)
                        stops.append(e)
                        cuts.append(1 << s | 1 << e)
                        inner.append((1 << e) - (1 << s + 1) if e > s + 1 else 0)
                        worth.append(score)
                ends.append(len(rank))
            told = [
                pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32())) if kind is None else pa.array(values, kind)
                for values, kind in zip(found, kinds, strict=True)
            ]
            edges = pa.StructArray.from_arrays(told, ["rank", "s", "e", "ends", "inner", "ids", "score"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), edges)], [*batch.schema.names, "edges"]
            )

    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    edge = "rank double, s int, e int, ends long, inner long, ids array<int>, score double"
    met = units.select("unit", *[f.name for f in others]).mapInArrow(run, f"unit string{schema}, edges array<struct<{edge}>>")
    return met.withColumn("edges", F.array_sort("edges"))


def fold_merges(edges: Column, n: Column) -> Column:
    """Ids of a merge model: as long as there is one, the best-scored edge over exactly two neighbours joins them."""
    one = F.lit(1).cast("long")
    all_cuts = F.call_function("shiftleft", one, n + 1) - 1

    def joined(cuts, _):
        open_ = F.filter(edges, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1))
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(F.get(open_["inner"], 0), F.lit(0).cast("long"))))

    def ids(cuts):
        left = F.filter(edges, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (cuts.bitwiseAND(x["inner"]) == 0))
        return F.flatten(F.transform(F.array_sort(F.transform(left, lambda x: F.struct(x["s"].alias("s"), x["ids"].alias("ids")))), lambda x: x["ids"]))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), all_cuts, joined, ids)


def fold_viterbi(edges: Column, n: Column) -> Column:
    """Ids of the path with the highest sum of scores; of equal paths the one whose edge starts first stays."""
    empty = F.array().cast("array<int>")
    far = F.lit(float("-inf"))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0.0).otherwise(far).alias("score"), F.lit(-1).alias("back"), empty.alias("ids")))
    ordered = F.array_sort(F.transform(edges, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["score"].alias("score"), x["ids"].alias("ids"))))

    def step(state, x):
        reached = F.element_at(state, x["s"] + 1)["score"] + x["score"]
        better = F.struct(reached.alias("score"), x["s"].alias("back"), x["ids"].alias("ids"))
        return F.transform(state, lambda v, i: F.when((i == x["e"]) & (reached > v["score"]), better).otherwise(v))

    def walk(state):
        begin = F.struct(n.alias("at"), empty.alias("ids"))

        def back(acc, _):
            here = F.element_at(state, acc["at"] + 1)
            return F.when(acc["at"] > 0, F.struct(here["back"].alias("at"), F.concat(here["ids"], acc["ids"]).alias("ids"))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), n), begin, back, lambda acc: acc["ids"])

    return F.aggregate(ordered, start, step, walk)


def merge_long(unit: str, pieces: Pieces) -> list[int]:
    """Ids of one long unit by the same merges, with a heap."""
    parts: list[str | None] = list(unit)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple] = []

    def propose(i):
        j = right[i]
        if j < len(parts) and (found := pieces.usable.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-pieces.scores[found], i, parts[i] + parts[j], j))

    for i in range(len(parts) - 1):
        propose(i)
    while heap:
        _, i, text, j = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != text:
            continue
        parts[i], parts[j] = text, None
        right[i] = right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        if left[i] >= 0:
            propose(left[i])
        propose(i)
    return [k for p in parts if p is not None for k in ([pieces.usable[p]] if p in pieces.usable else pieces.fallback(p))]


def viterbi_long(unit: str, pieces: Pieces) -> list[int]:
    """Ids of one long unit by the same path sums."""
    longest = max((len(t) for t in pieces.usable), default=1)
    worst = min((pieces.scores[i] for i in pieces.usable.values()), default=0.0) - 10.0
    best: list[tuple] = [(0.0, -1, [])] + [(float("-inf"), -1, [])] * len(unit)
    for s in range(len(unit)):
        for e in range(s + 1, min(len(unit), s + longest) + 1):
            found = pieces.usable.get(unit[s:e])
            if found is None and e > s + 1:
                continue
            score, ids = (worst, pieces.fallback(unit[s])) if found is None else (pieces.scores[found], [found])
            if best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, ids)
    out, at = [], len(unit)
    while at > 0:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, ids`` for distinct units, with their other columns. Rows already dealt out by unit are not shuffled again."""
    n = F.col("n") if "n" in units.columns else F.char_length("unit")
    others = [f for f in units.schema.fields if f.name not in ("unit", "n")]
    kept = [f.name for f in others]
    fold = fold_viterbi if pieces.unigram else fold_merges
    short = lattice(units.filter(n.between(1, FOLDED)).select("unit", *kept), pieces).select("unit", *kept, fold(F.col("edges"), F.char_length("unit")).alias("ids"))
    shared = units.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        import pyarrow as pa

        encode = viterbi_long if shared.value.unigram else merge_long
        for batch in batches:
            ids = [encode(u, shared.value) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["unit", *kept, "ids"])

    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return short.unionByName(units.filter(n > FOLDED).select("unit", *kept).mapInArrow(run, f"unit string{schema}, ids array<int>"))


def _unit_rows(texts: DataFrame, pieces: Pieces, frequent, merged: bool = False) -> DataFrame:
    """``bucket, unit`` for the different units of each text of ``bucket, text`` that are not frequent; if ``merged``, once for the texts of a bucket that lie together."""

    def run(batches):
        import pyarrow as pa

        known, (split, prepared) = frequent.value, (pieces.splitter().findall, pieces.prepared)
        for batch in batches:
            found: dict[int, list[str]] = {}
            for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(bucket, []).extend({u for u in split(prepared(text.as_py())) if u not in known})
            for bucket, units in found.items():
                units = sorted(set(units) if merged else units)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(units), pa.int32()), pa.array(units, pa.string())], ["bucket", "unit"])

    return texts.select("bucket", "text").mapInArrow(run, "bucket int, unit string")


def encode_texts(
    docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT, sample: int = SAMPLE, unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, n_tokens, ids, round_trip``.

    ``ids`` are those the SentencePiece library gives, and ``round_trip`` tells
    whether they decode to the text. NULL and empty texts have no ids. Which
    units count as frequent is told by a sample of the texts and changes the
    speed only. Repeated rows and NULL keys are rows like any other. Texts are
    dealt into buckets by key and content; a bucket's texts meet the ids of its
    units, each once, in one task.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long"), value).alias("mark"), value.alias("text"))
    rows, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    share = min(1.0, sample / max(1, rows))
    own = own.withColumn("bucket", F.pmod("mark", F.lit(max(BUCKETS, math.ceil(rows / BUCKET_TEXTS)))).cast("int"))
    nothing = spark.sparkContext.broadcast(frozenset())
    drawn = own.filter(F.pmod(F.xxhash64("mark", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    counted = _unit_rows(drawn, pieces, nothing).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "unit").limit(frequent).select("unit")
    known = spark.sparkContext.broadcast({r.unit: tuple(r.ids) for r in encode_units(saved(top).repartition("unit"), pieces).toLocalIterator()})

    # The length is an aggregate, so the short and the long units read one shuffle.
    # A number given is not coalesced, so the edges of a partition are bounded whatever the size of the table.
    rare = _unit_rows(own, pieces, known, merged=True).repartition(max(1, math.ceil(size / unit_bytes)), "unit")
    units = rare.groupBy("unit").agg(F.collect_set("bucket").alias("buckets"), F.max(F.char_length("unit")).alias("n"))
    encoded = encode_units(units, pieces).select("buckets", "unit", "ids")

    def dealt(batches):
        import json

        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            told: dict[int, list] = {}
            for buckets, unit, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for bucket in buckets:
                    told.setdefault(bucket, []).append((unit, ids))
            blobs = [press(json.dumps(dict(x), ensure_ascii=False, separators=(",", ":")).encode()) for x in told.values()]
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array([False] * len(told)), none, pa.array(blobs, pa.binary())], ["bucket", "is_text", "doc_id", "blob"])

    def packed(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            blobs = [press(t.as_py().encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * len(blobs)), batch.column(1), pa.array(blobs, pa.binary())], ["bucket", "is_text", "doc_id", "blob"])

    schema = "bucket int, is_text boolean, doc_id long, blob binary"
    texts = own.select("bucket", "doc_id", "text").mapInArrow(packed, schema)
    together = encoded.mapInArrow(dealt, schema).unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "is_text", "doc_id")

    def assembled(batches):
        import json

        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        split, ids_of, written = pieces.splitter().findall, known.value, pieces.written()
        at, here, last, done = None, {}, None, ([], True)

        def handed(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.bool_()))], ["doc_id", "ids", "round_trip"]
            )

        for batch in batches:
            out, held = [], 0
            for bucket, is_text, doc, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, here, last = bucket, {}, None
                if not is_text:
                    here.update(json.loads(open_(blob)))
                    continue
                if blob != last:
                    whole = open_(blob).decode()
                    ids: list[int] = []
                    for unit in split(pieces.prepared(whole)):
                        ids += here[unit] if (got := ids_of.get(unit)) is None else got
                    last, done = blob, (ids, pieces.decode(ids, written) == whole)
                out.append((doc, *done))
                held += len(done[0])
                if held >= HANDED_IDS:
                    yield handed(out)
                    out, held = [], 0
            yield handed(out)

    each = together.mapInArrow(assembled, "doc_id long, ids array<int>, round_trip boolean")
    return each.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def decode_texts(rows: DataFrame, pieces: Pieces, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` for every row; NULL ids give NULL, bytes that are no text the replacement character."""

    def run(batches):
        import pyarrow as pa

        written = pieces.written()
        for batch in batches:
            texts = [None if i is None else pieces.decode(i, written) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
