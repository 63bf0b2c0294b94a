import corpus_pipeline
from gridsmith.llm.queries import QUERIES
from gridsmith.llm.simhash import drop_near_copies, near_groups


def words(seed, n):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randint(0, 99_999)}" for _ in range(n)]


def test_near_groups_against_brute_force(spark):
    rows, sets = [], {}
    for g in range(12):
        base = words(g, 200)
        for c in range(8):
            text = list(base)
            for k in range(c):
                text[(k * 23 + c) % 200] = f"x{g}_{c}_{k}"
            rows.append((100 * g + c, " ".join(text)))
    rows += [(5000 + i, " ".join(words(900 + i, 150))) for i in range(60)] + [(6000, None), (6001, ""), (6002, "one"), (6003, "one"), (None, "one")]
    for d, t in rows:
        w = (t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    keys = [d for d, _ in rows if d is not None]

    def closure(similarity):
        root = {d: d for d in keys}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in keys:
            for b in keys:
                if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        return {d: find(d) for d in keys}

    whole, close = closure(0.8), closure(0.85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.keep_id for r in near_groups(docs).collect()}
    label = {d: found.get(d, d) for d in keys}
    assert label == whole and all(label[close[d]] == label[d] for d in keys)
    left = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert left == {d for d in keys if label[d] == d}
    assert drop_near_copies(docs.limit(0)).collect() == []


def test_stages_keep_columns_and_shrink(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        docs = docs.persist()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0.6 * sizes[0]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][3] == "near_dedup"


def test_near_copies_behind_a_nearer_text_that_is_not_one(spark):
    """A member reached only through another, and one whose nearest in every cell fails, are found for sure."""
    base = words(77, 400)
    chain = [base[k * 15 :] + words(500 + k, k * 15) for k in range(9)]
    crowd = [base[: 300 - i] + words(600 + i, 100 + i) for i in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(chain + crowd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in chain + crowd]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
                    changed = True
    for tile in (5, 4096):
        found = {r.doc_id: r.keep_id for r in near_groups(docs, tile=tile).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == label


def test_near_groups_equal_brute_force(spark):
    """Not one pair at the border of 0.8 is missed."""
    rows = []
    for g in range(40):
        base = words(2000 + g, 120)
        for c in range(4):
            text = list(base)
            for k in range(c):
                text[(k * 29 + 7 * c) % 120] = f"x{g}_{c}_{k}"
            rows.append((10 * g + c, " ".join(text[: 120 - 2 * c])))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = {r.doc_id: r.keep_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: found.get(d, d) for d in sets} == label


def test_rows_of_one_key_are_decided_one_by_one(spark):
    """A rejected, toxic or copied row does not take another text of its key with it."""
    from gridsmith.llm.language import drop_unknown
    from gridsmith.llm.toxicity import drop_toxic

    base = words(31, 100)
    near = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (2, " ".join(words(32, 100))), (2, "12 34"), (3, " ".join([*base, "x"])), (3, " ".join([*base, "y"]))]
    docs = spark.createDataFrame([(d, t, "aa") for d, t in near], "doc_id long, text string, lang string")
    left = sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect())
    assert left == sorted([near[0], near[2], near[3]])
    left = sorted((r.doc_id, r.text) for r in drop_unknown(docs, docs).collect())
    assert left == sorted(n for n in near if n[1] != "12 34")
    taught = [(100 + i, f"zorgle quaxxy w{i}" if i % 3 == 0 else f"calm day w{i}", int(i % 3 == 0)) for i in range(300)]
    texts = spark.createDataFrame([(d, t) for d, t, _ in taught] + [(7, "zorgle quaxxy"), (7, "calm day")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, n) for d, _, n in taught], "doc_id long, toxic int")
    assert [r.text for r in drop_toxic(texts, labels).filter("doc_id = 7").collect()] == ["calm day"]


def odd_documents(spark):
    """Two hundred teaching rows, then nulls, ties, repeats, an empty and a long text, under columns named like the helpers' own."""
    talk = ["the quick brown fox jumps over the lazy dog again and again while birds sing " * 2, "der schnelle braune fuchs springt ueber den faulen hund und die voegel singen " * 2]
    rows = [(i, f"{talk[i % 2]} part {i} {i * 7 % 31} {i * 13 % 57} {i * 3} {i * i}", ("en", "de")[i % 2]) for i in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34", "de"), (None, "12 34", None), (None, talk[0], "en"), (None, talk[0], "en"), (903, talk[0], "en"), (904, talk[0] + " ", "en"),
             (905, talk[1] * 300, "de"), (7, talk[1] + " other words here", "de"), (7, talk[1] + " other words here", "de")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _bad int, _tie string, _key int, _sha string, _place int, _sha_kept int"
    return spark.createDataFrame([(k, t, g, "s", len(t or ""), 1, "t", 2, "h", 3, 4) for k, t, g in rows], schema)


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 40 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = {}
    for (name, stage), held in zip(corpus_pipeline.STAGES, [docs] * 4 + [None], strict=True):
        if held is None:
            continue
        found = stage(spark, held, str(tmp_path))
        assert found.columns == docs.columns
        left[name] = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
        if name != "toxicity":  # which needs labelled texts
            assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert not {k for k, _ in left["language"]} & {900, 901, 902} and (None, "12 34") not in left["language"]
    equal = [r for r in left["exact_dedup"] if r[1] and r[1].split() == odd_documents(spark).filter("doc_id = 903").first()["text"].split()]
    assert equal == [(904, equal[0][1])]  # the longest of equal texts
    assert sum(k == 7 and "other" in t for k, t in left["exact_dedup"]) == 1
    assert not any(k is None and t and "quick" in t for k, t in left["near_dedup"])  # behind 903 and 904
    assert 900 in {k for k, _ in left["near_dedup"]}


def test_near_copies_without_keys(spark):
    """Two texts that only rows without a key have are near copies, and one of them goes."""
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(None, text), (None, text + " end"), (5, "something else " * 9), (None, text)], "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in drop_near_copies(docs).collect()]
    assert (5, "something else " * 9) in left and len({t for _, t in left}) == 2


def test_near_copies_stage_links_fingerprints(spark):
    """Fingerprints within four bits link texts that have fewer shingles in common; shingles link others to any member."""
    from gridsmith.llm.simhash import fingerprint

    base = words(41, 60)
    many = [[*base[:at], f"y{at}_{k}", *base[at + 1 :]] for at in range(20, 41, 2) for k in range(60)]
    one = fingerprint(" ".join(base))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, *many)]
    twice = [[*t[:8], f"z{k}", *t[9:]] for k, t in enumerate(many)]
    far = next(
        t for t in twice
        if (fingerprint(" ".join(t)) ^ one).bit_count() <= 4
        and len(sets[0] & (s := {tuple(t[i : i + 5]) for i in range(len(t) - 4)})) < 0.8 * len(sets[0] | s)
    )
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(words(42, 60))), (4, " ".join([*far[:-1], "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 3]


def test_cells_with_the_same_rows_are_told_once(spark):
    from gridsmith.llm.simhash import _cells

    sets = spark.createDataFrame([(1, [10, 11, 12, 13]), (2, [10, 11, 12]), (3, [12, 14])], "node long, rare array<long>")
    assert sorted(map(tuple, _cells(sets).collect())) == [(1, 10), (1, 12), (2, 10), (2, 12), (3, 12)]
