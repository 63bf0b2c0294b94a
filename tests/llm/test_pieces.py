import itertools
import re

import pytest
from pyspark.sql import functions as F

from gridsmith.llm.pieces import Pieces, decode_texts, encode_texts, encode_units, lattice, read_model

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "a", "Hello world", "  two  blanks ", "línea\nnueva\t\ttab", "x" * 300, "the " * 50, "é" * 70, "🙂 emoji 漢字 ▁ mark", " " * 40 + "deep",
    "internationalization antidisestablishmentarianism", "\n\n\n", "aaaaaaa bbbbbb abababab", "A.B,C;D!" * 12, "\x00\x01", "word " * 3000, "same", "same",
]


def library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [model.encode(t or "") for t in texts], model


@pytest.mark.parametrize("frequent", [3, 200_000])
def test_ids_are_the_librarys(spark, frequent):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "same"), (18, "same")], "doc_id long, text string").withColumn("ids", F.lit(1))
    pieces = read_model(MODEL)
    found = encode_texts(docs, pieces, frequent=frequent)
    expected, model = library(TEXTS)
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.ids == (expected[r.doc_id] if r.doc_id is not None else expected[18])
        assert r.n_tokens == len(r.ids)
        assert r.round_trip or "▁" in TEXTS[r.doc_id]
    decoded = {r.doc_id: r.text for r in decode_texts(found.filter("doc_id is not null"), pieces).collect()}
    assert all(decoded[i] == model.decode(e) for i, e in enumerate(expected))
    assert encode_texts(docs.limit(0), pieces).collect() == []


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in encode_texts(docs, read_model(MODEL), frequent=500).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected, _ = library(texts.values())
    assert all(rows[d].ids == e and rows[d].round_trip for d, e in zip(texts, expected, strict=True))


def test_unigram_paths_are_the_best(spark):
    table = {"a": -3.0, "b": -3.5, "c": -4.0, "ab": -4.2, "bc": -4.1, "abc": -7.0, "ca": -5.0, "aab": -6.5, "▁": -2.0, "▁a": -3.1}
    pieces = Pieces(["<unk>", *table], [0.0, *table.values()], [2] + [1] * len(table), unigram=True)
    units = ["".join(u) for n in range(1, 6) for u in itertools.product("abc", repeat=n)] + ["▁abca", "axb", "▁x", "abc" * 25]
    found = {r.unit: r.ids for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}

    def score(ids):
        return sum(-17.0 if i == 0 else pieces.scores[i] for i in ids)

    def best(unit):
        out = [0.0] + [float("-inf")] * len(unit)
        for s in range(len(unit)):
            for e in range(s + 1, len(unit) + 1):
                if unit[s:e] in table or e == s + 1:
                    out[e] = max(out[e], out[s] + table.get(unit[s:e], -17.0))
        return out[-1]

    assert set(found) == set(units)
    for unit, ids in found.items():
        assert abs(score(ids) - best(unit)) < 1e-9
        if "x" not in unit:
            assert "".join(pieces.texts[i] for i in ids) == unit


def test_units_are_shuffled_once_for_short_and_long_ones(spark):
    pieces = Pieces(["<unk>", "a", "b", "ab"], [0.0, -1.0, -2.0, -0.5], [2, 1, 1, 1])
    docs = spark.createDataFrame([(i, "ab " * (i % 3) + "b" * (70 if i % 5 == 0 else 3)) for i in range(40)] + [(7, "ab"), (7, "ab"), (None, None)], "doc_id long, text string")
    out = encode_texts(docs, pieces, frequent=1)
    rows = out.collect()
    assert len(rows) == 43 and all(r.round_trip or pieces.unknown in r.ids for r in rows)
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_units_are_dealt_into_more_partitions_for_more_text(spark):
    pieces = Pieces(["<unk>", "a", "b", "ab"], [0.0, -1.0, -2.0, -0.5], [2, 1, 1, 1])
    docs = spark.createDataFrame([(i, "ab" * (i + 1) + " " + "ba" * 45) for i in range(30)] + [(30, None)], "doc_id long, text string")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    one, many = (encode_texts(docs, pieces, frequent=1, unit_bytes=n) for n in (10**9, 500))
    assert sorted(one.collect()) == sorted(many.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    # Spark never coalesces a repartition by a given number.
    assert re.search(rf"hashpartitioning\(unit#\d+, {-(-size // 500)}\), REPARTITION_BY_NUM", plan)


def test_matches_stay_inside_the_row_of_their_unit(spark):
    pieces = Pieces(["<unk>", "a", "b", "ab", "ba"], [0.0, -1.0, -2.0, -0.5, -0.7], [2, 1, 1, 1, 1])
    units = spark.createDataFrame([("ab" * 30, 1), ("x", 2), ("aéb", None)], "unit string, n_docs int")
    met = lattice(units, pieces)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan
    rows = {r.unit: r for r in met.collect()}
    assert {u: r.n_docs for u, r in rows.items()} == {"ab" * 30: 1, "x": 2, "aéb": None}
    assert len(rows["ab" * 30].edges) == 60 + 59
    assert [(e.s, e.e, e.ends, e.inner, e.ids, e.score) for e in rows["aéb"].edges] == [
        (0, 1, 3, 0, [1], -1.0), (2, 3, 12, 0, [2], -2.0), (1, 2, 6, 0, [0], -12.0),
    ]
    assert [(e.s, e.e, e.inner) for e in rows["ab" * 30].edges[:2]] == [(0, 2, 2), (2, 4, 8)]
