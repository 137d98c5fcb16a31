"""Exact dedup, line dedup: brute force, awkward rows, skew paths, the persistent index."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import pytest

from riskloom.llm import exact_dedup, line_dedup
from tests.llm.helpers import awkward, docs


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_parts", [1, 5, 100_000])
def test_exact_dedup_matches_brute_force(spark, hot_parts):
    rng = random.Random(1)
    rows = awkward() + [(100 + i, rng.choice(["x y", "x  y", "z", "same text", f"own {i}"])) for i in range(200)]
    got = exact_dedup.absorb(exact_dedup.fresh_index(spark, 4), docs(spark, rows, clash=True), hot_parts)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(rows)


def test_index_persists_across_batches(spark):
    index = exact_dedup.fresh_index(spark, 4)
    assert index.read().columns == ["digest", "keep_id"] and index.read().count() == 0  # the anti-join has its table
    exact_dedup.absorb(index, docs(spark, [(5, "a b"), (6, "c")])).collect()
    again = {r["doc_id"]: r for r in exact_dedup.absorb(index, docs(spark, [(1, "a  b"), (2, "d"), (3, "d")])).collect()}
    assert (again[1]["keep_id"], again[1]["kept"]) == (5, False)
    assert (again[2]["kept"], again[3]["kept"], again[3]["keep_id"]) == (True, False, 2)
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 5, 6]


def test_index_side_is_not_shuffled(spark):
    index = exact_dedup.fresh_index(spark, 4)
    exact_dedup.absorb(index, docs(spark, [(1, "a")])).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = exact_dedup.absorb(index, docs(spark, [(2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_empty_table(spark):
    assert exact_dedup.absorb(exact_dedup.fresh_index(spark, 2), docs(spark, [])).count() == 0
    assert line_dedup.line_report(docs(spark, [])).count() == 0
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=rank) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("hot_parts", [1, 100_000])
def test_line_dedup_matches_brute_force(spark, monkeypatch, hot_parts):
    monkeypatch.setattr(line_dedup, "HOT_PARTS", hot_parts)
    rng = random.Random(2)
    pool = ["a very common line", " A Very Common Line ", "short", "", "another line of text", "\tlicense footer line\r"]
    rows = awkward() + [(200 + i, "\n".join(rng.choice(pool + [f"own line number {i}"]) for _ in range(rng.randint(1, 9))))
                        for i in range(150)]
    want = [(d, n, k, sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(rows)]
    got = line_dedup.line_report(docs(spark, rows, clash=True))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_line_dedup_keeps_columns_and_null_text(spark):
    source = docs(spark, awkward(), clash=True)
    got = line_dedup.line_dedup(source)
    assert got.columns == source.columns and got.count() == source.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[4]["text"] is None and by_id[5]["text"] == ""
    assert by_id[11]["text"] == "last" and by_id[11]["n_chars"] == 4
    assert by_id[10]["text"].count("line that is repeated") == 2
    assert by_id[2]["text"] == ""  # every line of it is held by document 1


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(1, "first line of one\nshared line here"), (1, "shared line here\nsecond line of one"), (2, "shared line here")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs(spark, rows)).collect())
    assert got == [(1, rows[0][1]), (1, rows[1][1]), (2, "")]


def test_higher_document_threshold(spark):
    rows = [(i, "shared line here" if i < 3 else "other shared line") for i in range(5)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(docs(spark, rows), min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
