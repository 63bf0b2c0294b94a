"""License scans as an exact set-similarity join between the blocks of texts and license templates.

Texts are cut into overlapping blocks of words. A block meets a template when it
holds at least a stated share of the template's different words. Words are put in
order of their frequency in the whole corpus, rarest first: a block that meets a
template holds one of the template's first words (prefix filter), has enough
words (length filter) and enough words left behind the first common one
(positional filter). What is left is counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import saved

#: Words of a block, and from one block's start to the next: a passage of STRIDE words lies whole in some block.
BLOCK, STRIDE = 256, 128
#: Hundredths of a notice's different words that a block must hold.
CONTAINMENT = 80

#: Phrases whose words stand consecutively, and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Opening passages of public license notices, and the labels of the method.
NOTICES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
     "copies of the software"),
    ("apache-2-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc-notice", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]
#: Fixed value: what is no part of a word, once A-Z are lower-cased; in UTF-8 all bytes from 0x80 belong to words.
WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Templates are sent to every task; more words than this are refused.
MOST_WORDS = 200_000


@dataclass(frozen=True)
class Template:
    """Words to find: all of a ``phrase``, one behind the other, or a share of a notice's."""

    label: str
    words: tuple[str, ...]
    phrase: bool
    need: int

    @property
    def different(self) -> set[str]:
        return set(self.words)


def templates(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, containment: int = CONTAINMENT) -> list[Template]:
    """Phrases need all their words; notices ``containment`` hundredths of them, rounded up."""
    out = []
    for label, text in [*phrases, *notices]:
        words, phrase = tuple(w.decode() for w in license_words(text)), len(out) < len(phrases)
        if not 0 < len(words) <= STRIDE:
            raise ValueError(f"template {label} must have 1 to {STRIDE} words, so that each of its places lies whole in a block")
        size = len(set(words))
        out.append(Template(label, words, phrase, size if phrase else max(1, -(-containment * size // 100))))
    if sum(len(t.words) for t in out) > MOST_WORDS:
        raise ValueError("too many template words to send to every task")
    return out


_BLANKED = bytes(b if b in WORD_BYTES else 0x20 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Words of ``text`` in UTF-8, A-Z lower-cased; NULL has none."""
    return text.encode().lower().translate(_BLANKED).split() if text else []


def _counted(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in all texts."""
    known = [w.encode() for w in vocabulary]

    def run(batches):
        import pyarrow as pa

        counts = dict.fromkeys(known, 0)
        for batch in batches:
            for text in batch.column(0):
                for word in license_words(text.as_py()):
                    if word in counts:
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    told = docs.select(F.col("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in told.collect()}  # one row for each template word


def _blocks(docs: DataFrame, order: dict[str, int], prefix: set[int]) -> DataFrame:
    """``doc_id, n_words, blocks``: of each text the blocks that hold a prefix word, as the numbers and places of their template words."""
    known = {w.encode(): n for w, n in order.items()}
    heads = frozenset(w for w, n in known.items() if n in prefix)
    schema = "doc_id long, n_words long, blocks array<struct<block: int, tokens: array<int>, seq: array<int>, places: array<long>>>"

    def cut(words):
        met = [(at, known[w]) for at, w in enumerate(words) if w in known]
        starts = sorted({b for at, n in met if n in prefix for b in (at // STRIDE - 1, at // STRIDE) if b >= 0})
        found, low, high = [], 0, 0
        for block in starts:
            while low < len(met) and met[low][0] < block * STRIDE:
                low += 1
            high = max(high, low)
            while high < len(met) and met[high][0] < block * STRIDE + BLOCK:
                high += 1
            inside = met[low:high]
            found.append({"block": block, "tokens": sorted({n for _, n in inside}), "seq": [n for _, n in inside], "places": [at for at, _ in inside]})
        return found

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.int32())), ("seq", pa.list_(pa.int32())), ("places", pa.list_(pa.int64()))]))
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1):
                words = license_words(text.as_py())
                sizes.append(len(words))
                found.append([] if heads.isdisjoint(words) else cut(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, shape)], ["doc_id", "n_words", "blocks"])

    return docs.mapInArrow(run, schema)


def _joined(blocks: DataFrame, wanted: list[Template], order: dict[str, int]) -> DataFrame:
    """One row for each block and template that meet: all columns of ``blocks``, the template's and ``overlap``."""
    spark, rows, prefixes = blocks.sparkSession, [], []
    for number, t in enumerate(wanted):
        tokens = sorted(order[w] for w in t.different)
        prefix = tokens[: len(tokens) - t.need + 1]
        rows += [(token, at, number) for at, token in enumerate(prefix)]
        prefixes.append((number, t.label, t.phrase, t.need, tokens, prefix, [order[w] for w in t.words]))
    index = spark.createDataFrame(rows, "token int, at int, number int").join(
        spark.createDataFrame(prefixes, "number int, label string, phrase boolean, need int, wanted array<int>, prefix array<int>, words array<int>"), "number"
    )
    heads = F.array(*[F.lit(n) for n in sorted({token for token, _, _ in rows})])
    probed = blocks.filter(F.size("tokens") >= min(t.need for t in wanted)).withColumn("token", F.explode(F.array_intersect("tokens", heads)))
    met = probed.join(F.broadcast(index), "token").withColumn("place", F.array_position("tokens", F.col("token")).cast("int"))
    behind = F.least(F.size("wanted") - F.col("at"), F.size("tokens") - F.col("place") + 1)
    met = met.filter(
        (F.size("tokens") >= F.col("need")) & (behind >= F.col("need"))
        & (F.size(F.array_intersect(F.slice("tokens", F.lit(1), F.col("place") - 1), "prefix")) == 0)  # each pair once, by its first common word
    )
    return met.withColumn("overlap", F.size(F.array_intersect("tokens", "wanted"))).filter(F.col("overlap") >= F.col("need"))


def _phrase_starts() -> Column:
    """Places of the block's own stretch at which the template's words stand one behind the other."""
    size = F.size("words")
    begins = F.filter(F.sequence(F.lit(1), F.size("seq")), lambda i: (
        (F.slice("seq", i, size) == F.col("words")) & (F.get("places", i + size - 2) - F.get("places", i - 1) == size - 1)
        & (F.floor(F.get("places", i - 1) / STRIDE) == F.col("block"))
    ))
    return F.transform(begins, lambda i: F.get("places", i - 1))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: list[Template] | None = None) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``matches`` lists each block that meets a template: its first word, label and
    containment. A phrase counts at every place where its words stand
    consecutively (``n_base``, and the smallest and largest of those places);
    ``labels`` adds the notices met. ``score`` is 1 for a text with a phrase, else
    the largest containment of a notice met, else 0. A NULL or empty text has no
    words and meets nothing; rows of one key are told apart and reported each; a
    NULL key stays NULL; an empty table gives no rows. Other columns are not read.
    """
    wanted = templates() if wanted is None else wanted
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = _counted(own, sorted({w for t in wanted for w in t.words}))
    order = {w: n for n, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    prefix = {n for t in wanted for n in sorted(order[w] for w in t.different)[: len(t.different) - t.need + 1]}
    # Rows get a number, which holds as the table is written before it is used.
    cut = saved(_blocks(own, order, prefix).withColumn("_row", F.monotonically_increasing_id()))
    blocks = cut.filter(F.size("blocks") > 0).select("_row", F.explode("blocks").alias("b")).select("_row", "b.*")
    met = _joined(blocks, wanted, order).withColumn("starts", F.when(F.col("phrase"), _phrase_starts()))
    share = F.col("overlap") / F.size("wanted")
    told = F.when(F.col("phrase"), F.size("starts") > 0).otherwise(F.lit(True))
    found = met.filter(told).groupBy("_row").agg(
        F.sum(F.when(F.col("phrase"), F.size("starts"))).alias("n_base"), F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"), F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"), F.max(share).alias("score"),
        F.array_sort(F.collect_list(F.struct((F.col("block") * F.lit(STRIDE)).alias("word"), "label", share.alias("containment")))).alias("matches"),
    )
    nothing = cut.filter(F.size("blocks") == 0).select("doc_id", "n_words", *[F.lit(None).alias(c) for c in found.columns if c != "_row"])
    some = cut.filter(F.size("blocks") > 0).select("_row", "doc_id", "n_words").join(found, "_row", "left").drop("_row")
    none = F.array().cast("array<struct<word: int, label: string, containment: double>>")
    listed = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return some.unionByName(nothing).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), listed(F.col("base")).alias("base_labels"), listed(F.col("all")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matches", none).alias("matches"),
    )


def scan_sql(wanted: list[Template] | None = None) -> str:
    """The same over ``documents`` in SQL, without ``matches``: every block against every template."""
    wanted = templates() if wanted is None else wanted
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places, shares, names, bases = [], [], [], []
    for t in wanted:
        if t.phrase:
            test = " AND ".join(f"w[i + {n + 1}] = '{word}'" for n, word in enumerate(t.words))
            places.append(f"list_filter(range(0, len(w) - {len(t.words) - 1}), lambda i: {test})")
            bases.append((t.label, f"p{len(places)}"))
        else:
            size = len(t.different)
            shares.append(f"list_max(list_transform(blocks, lambda x: len(list_intersect(x, {quoted(sorted(t.different))}))))")
            names.append((t.label, f"s{len(shares)}", t.need, size))
    base = "list_filter([" + ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in bases) + "], lambda x: x IS NOT NULL)"
    more = "list_filter([" + ", ".join(f"CASE WHEN {s} >= {need} THEN '{label}' END" for label, s, need, _ in names) + "], lambda x: x IS NOT NULL)"
    joined = "list_concat(" * (len(places) - 1) + "p1" + "".join(f", p{n + 1})" for n in range(1, len(places)))
    best = ", ".join(f"CASE WHEN {s} >= {need} THEN {s} / {size} ELSE 0.0 END" for _, s, need, size in names)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT *, list_transform(range(0, greatest(1, (len(w) + {STRIDE - 1}) // {STRIDE})), lambda n: list_distinct(list_slice(w, n * {STRIDE} + 1, n * {STRIDE} + {BLOCK}))) AS blocks FROM t
), c AS (
  SELECT doc_id, len(w) AS n_words, {", ".join(f"{p} AS p{n + 1}" for n, p in enumerate(places))}, {", ".join(f"coalesce({s}, 0) AS s{n + 1}" for n, s in enumerate(shares))} FROM b
), d AS (
  SELECT *, {joined} AS places, list_sort(list_distinct({base})) AS base, {more} AS more FROM c
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0 ELSE greatest({best}) END::DOUBLE AS score
FROM d
"""
