import hashlib
import re

import pytest

from gridsmith.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, (_, t) in enumerate(rows)}
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [j for j in norm if norm[j] == norm[i]]
        best = min(same, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((doc, rows[best][0], len(same), hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "A b"), (8, "a b"), (9, "é ü"), (10, "éü"), (None, "ab"),
    (11, "x" * 300_000), (12, "x" * 299_999 + " x"), (13, "x" * 299_999), (14, "same"), (14, "same"), (None, None),
]


@pytest.mark.parametrize("local_rows", [2, 200_000])
@pytest.mark.parametrize("digest", [None, lambda b: b[:1]])
def test_groups_equal_brute_force(spark, local_rows, digest):
    rows = ROWS + [(100 + i, "hot text" if i % 3 else f"own {i // 2}") for i in range(120)]
    docs = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, lid string, blob int").repartition(5)
    found = exact_groups(docs, local_rows=local_rows, **({"digest": digest} if digest else {})).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == brute(rows)
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in found})


def test_empty_table_and_dropping(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert exact_groups(docs.limit(0)).collect() == []
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {3, 6, 7, 8, 9, 12, 14}
