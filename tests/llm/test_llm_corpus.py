"""Jaccard join, mixing, language ID, quality and the pipeline."""

import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from riskloom.llm import decontaminate, graph, langid, mixing, ngram_join, quality
from riskloom.llm.shared import table
from tests.llm.helpers import WORDS, awkward, docs

SMALL = "/root/testdata/sf0.001"


# -- Jaccard join -------------------------------------------------------------
def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_components(rows, percent=85, n=4):
    sets = defaultdict(set)
    for r in rows:
        sets[r[0]].add(shingles(r[1], n))
    rank = lambda d: (d is None, d or 0)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            lo, hi = sorted((find(a), find(b)), key=rank)
            root[hi] = lo
    return sorted([(r[0], len(shingles(r[1], n)), find(r[0])) for r in rows], key=repr)


def near_copies(seed, groups=12, most=14):
    rng = random.Random(seed)
    rows, i = [], 1000
    for g in range(groups):
        base = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(4, 160))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(w) - 1)
                w[at:at + rng.randint(0, 1)] = [rng.choice(WORDS) + str(rng.randint(0, 40))]
            if rng.random() < 0.3:
                w += base[: rng.randint(0, 12)]
            rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3)])
def test_jaccard_join_matches_brute_force(spark, seed, block):
    rows = awkward() + near_copies(seed) + near_copies(seed + 50, 1, 60)
    got = ngram_join.jaccard_join(docs(spark, rows, clash=True), block=block)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    have = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=repr)
    want = brute_components(rows)
    assert have == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_jaccard_join_of_awkward_tables(spark):
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "same"), (4, "SAME"), (4, "SAME"), (None, "same"), (5, "other words here now")]
    got = ngram_join.jaccard_join(docs(spark, rows))
    assert sorted([tuple(r)[:3] for r in got.collect()], key=repr) == brute_components(rows)


def test_prefix_and_bitmap_bounds_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        words = min(len(x), len(y)) // 8
        bits = np.bitwise_count(ngram_join.folded(x, words) ^ ngram_join.folded(y, words)).sum()
        assert common <= (len(a) + len(b) - int(bits)) // 2
        if ngram_join.linked(common, len(a), len(b)):
            first = lambda s: set(s[:len(s) + (-85 * len(s)) // 100 + 1].tolist())
            assert first(a) & first(b)


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(12)
    seen = {}
    for _ in range(400):
        t = "".join(rng.choice("aAbZ \t\n\x0b\x1cé ​") for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t))
        got = ngram_join.word_hashes(t).tolist()
        monkeypatch.setattr(ngram_join, "CHUNK", 7)
        assert ngram_join.word_hashes(t).tolist() == got
        monkeypatch.setattr(ngram_join, "CHUNK", 1 << 20)
        assert len(got) == len(words)
        for w, h in zip(words, got):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 3)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- mixing -------------------------------------------------------------------
def test_knapsack_reaches_the_best_sum():
    rng = random.Random(5)
    for _ in range(300):
        sizes = rng.sample(range(1, 30), rng.randint(0, 6))
        counts = [rng.randint(0, 5) for _ in sizes]
        budget = rng.randint(0, 120)
        got = mixing.knapsack(sizes, counts, budget)
        assert all(n <= counts[sizes.index(s)] for s, n in got.items())
        sums = {sum(s * n for s, n in zip(sizes, pick)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= budget)


def test_fit_budget_stays_within_counts_and_near_the_budget():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = np.unique(rng.integers(0, 4000, rng.integers(1, 200)))
        counts = rng.integers(1, 50, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit_budget(sizes, counts, budget, dp_words=3000)
        assert (taken >= 0).all() and (taken <= counts).all()
        got = int((sizes * taken).sum())
        assert got <= budget and (budget - got <= max(sizes))


def test_long_texts_take_part_in_the_knapsack():
    rng = random.Random(10)
    for _ in range(60):
        sizes = sorted(rng.sample(range(25_000, 150_001), rng.randint(1, 4)))
        counts = [rng.randint(1, 4) for _ in sizes]
        budget = rng.randint(1, sum(s * c for s, c in zip(sizes, counts)))
        taken = mixing.fit_budget(np.array(sizes), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {sum(s * n for s, n in zip(sizes, pick)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        best = max(x for x in sums if x <= budget)
        if budget <= mixing.COVER * sizes[-1] or budget == sum(s * c for s, c in zip(sizes, counts)):
            assert int((np.array(sizes) * taken).sum()) == best
    assert int((np.array([100_001, 150_000]) * mixing.fit_budget(np.array([100_001, 150_000]), np.array([4, 4]), 400_010)).sum()) == 400_004


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, cap = sum(sizes.values()), {n: 3 * sizes[n] for n in names}
    t = {n: total * w[n] / sum(w.values()) for n in names}
    for _ in range(200):
        over = sum(max(0, t[n] - cap[n]) for n in names)
        t = {n: min(t[n], cap[n]) for n in names}
        free = [n for n in names if t[n] < cap[n]]
        if over < 1e-9 or not free:
            break
        for n in free:
            t[n] += over * w[n] / sum(w[m] for m in free)
    return t


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(7)
    rows = awkward()
    for i in range(400):
        source = rng.choice(["a", "B", "é", "zz", "zz", "zz", None, ""])
        rows.append((600 + i, " ".join(rng.choice(WORDS) for _ in range(7 if i % 3 else rng.randint(0, 90))), "en", source))
    rows.append((5000, "tiny one", "en", "0-small"))
    source = docs(spark, rows, clash=True)
    got = mixing.mix(source).collect()
    again = mixing.mix(source.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in {k * r["size"] for k in range(4)}
    want = brute_targets(sizes)
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        if s != "s":
            assert abs(taken[s] - want[s]) <= 3
    # source "s" is two texts of 30,000 words and a few small ones: as near as any choice of copies comes
    one = [r["size"] for r in got if r["source"] == "s"]
    sums = {0}
    for size in one:
        sums = {x + k * size for x in sums for k in range(4)}
    assert taken["s"] == max(x for x in sums if x <= round(want["s"]))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# -- language ID -----------------------------------------------------------------
def test_language_held_out_accuracy_and_rejection(spark):
    source = table(spark, SMALL, "documents")
    rows = source.select("doc_id", "text", "lang").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    model = langid.fit(docs(spark, [(r[0], r[1], r[2]) for r in rows if not held(r[0])], clash=True))
    got = {r["doc_id"]: r for r in langid.predict(source, model).collect()}
    test = [r for r in rows if held(r[0])]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) == 0
    odd = [(1, None), (2, ""), (3, "12 -- 3"), (4, "это совсем другой язык с другими буквами и словами"), (None, "the"),
           (5, "zqxj " * 200), (6, "the and of " * 200_000)]
    out = {r["doc_id"]: r for r in langid.predict(docs(spark, odd, clash=True), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(out[i]["rejected"] for i in (1, 2, 3, 4, 5))
    assert out[6]["lang_pred"] == "en" and not out[6]["rejected"] and not out[None]["rejected"]
    kept = langid.accepted(docs(spark, odd, clash=True), model)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [6, None]


def test_language_model_of_awkward_tables(spark):
    nothing = langid.fit(docs(spark, [(1, "text", None), (2, None, "en")]))
    assert [r["lang_pred"] for r in langid.predict(docs(spark, [(1, "text")]), nothing).collect()] == ["und"]
    assert langid.predict(docs(spark, []), langid.fit(docs(spark, []))).count() == 0


def test_trigrams_do_not_depend_on_the_chunk(monkeypatch):
    text = "Ein längerer Text, with mixed words " * 300
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    parts = langid.trigram_counts(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


# -- quality -----------------------------------------------------------------------
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        emit, trans = rng.normal(0, 2, (1, n)), rng.normal(0, 1, (2, 2))
        weight = {}
        for tags in itertools.product((0, 1), repeat=n):
            weight[tags] = np.exp(sum(emit[0, i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        total = sum(weight.values())
        want = [sum(w for t, w in weight.items() if t[i]) / total for i in range(n)]
        moved = np.zeros((2, 2))
        for t, w in weight.items():
            for a, b in zip(t, t[1:]):
                moved[a, b] += w / total
        padded = np.concatenate([emit, np.full((1, 3), 5.0)], axis=1)
        got, pair = quality.marginals(padded, np.arange(n + 3)[None] < n, trans)
        assert np.allclose(got[0, :n], want) and np.allclose(pair, moved)


def test_quality_held_out_accuracy(spark):
    source, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learn = spark.createDataFrame([(d, q) for d, q in marks.items() if not held(d)], "doc_id long, quality int")
    model = quality.fit(source, learn)
    got = {r["doc_id"]: r for r in quality.score(source, model).collect()}
    test = [d for d in marks if held(d) and d in got]
    assert sum(got[d]["predicted"] == marks[d] for d in test) >= 0.95 * len(test)
    good = [got[d]["score"] for d in test if marks[d] == 1]
    bad = [got[d]["score"] for d in test if marks[d] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    out = quality.score(docs(spark, awkward(), clash=True), model).collect()
    assert len(out) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert quality.score(docs(spark, []), model).count() == 0


def test_quality_without_labels(spark):
    source = docs(spark, [(1, "a text"), (2, None)])
    none = quality.fit(source, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(source, none).collect()] == [0.5, 0.5]
    one = quality.fit(source, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(r["predicted"] == 1 for r in quality.score(source, one).collect())


# -- pipeline ----------------------------------------------------------------------
def _write(spark, folder, rows, items):
    docs(spark, rows, clash=True).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    clean = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, clean(14)) for i in range(3)] + [(9, None)]
    rows = [(i, "\n".join(clean(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))), "en", rng.choice(["a", "b", None]))
            for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("river", "stream", 1) + " tail", "en", "a") for i in range(10)]
    rows += [(200 + i, f"{clean(9)} {items[i][1]} {clean(5)}", "en", "c") for i in range(3)]
    rows += [(300, None), (301, ""), (302, "123 456"), (303, "это другой язык " * 9, None), (None, clean(20)), (304, clean(9)), (304, clean(9))]
    pair = [f"w{i}" for i in range(100)]               # two inner words changed: 105 / 86 shingles of five words
    rows += [(500, " ".join(pair), "en", "a"), (501, " ".join(["x" if i in (30, 60) else w for i, w in enumerate(pair)]), "en", "a")]
    rows += [(502, rows[0][1], "en", "b")]             # every line is held by document 0
    rows += [(400 + i, "a licence line that many documents share\n" + clean(25), "en", "b") for i in range(8)]
    _write(spark, str(tmp_path), rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    from tests.llm.test_llm_dedup import brute_lines
    model = langid.fit(table(spark, str(tmp_path), "documents").filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    assert not {300, 301, 302, 303} & {r[0] for r in kept} and len(kept) == len(rows) - 4
    lines = brute_lines(kept)
    by_doc = [(r[0], line[3], r[3] if len(r) > 3 else "s") for r, line in zip(kept, lines)]
    by_doc = [r for r in by_doc if r[1].split()]       # line dedup leaves no document without words
    comp = {d: c for d, _, c in brute_components(by_doc, percent=80, n=5)}
    left = [r for r in by_doc if comp[r[0]] == r[0]]
    found = decontaminate.Matcher([(i, decontaminate.normal(t)) for i, t in items if t], decontaminate.ERROR_RATE)
    left = [r for r in left if not found.match(decontaminate.normal(r[1]))]
    assert not {200, 201, 202, 501, 502} & {r[0] for r in left} and 500 in {r[0] for r in left}
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in left), key=repr)
    sizes = defaultdict(int)
    for _, t, s in left:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in got)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    _write(spark, str(tmp_path), awkward(), [(1, "an item that no document holds")])
    start = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, start, str(tmp_path)).columns == start.columns
        assert stage(spark, start.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, start.limit(0), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_long_documents_teach_by_pieces_of_all_of_them(spark):
    short = "\n".join(["a line"] * 1999) + "\n"
    assert quality.sample_pieces(short) == [short] and quality.sample_pieces("") == [""]
    long = "\n".join(f"line {i}" for i in range(20_000))
    got = quality.sample_pieces(long)
    assert len(got) == quality.SAMPLE_PIECES and all(p.count("\n") < quality.SAMPLE_LINES for p in got)
    assert got[0].startswith("line 0\n") and got[-1].endswith("line 19999")
    lines = set(long.split("\n"))
    assert all(set(p.split("\n")) <= lines for p in got)
    endless = quality.sample_pieces("x" * 1_500_000)
    assert len(endless) == quality.SAMPLE_PIECES and max(map(len, endless)) <= quality.SAMPLE_CHARS
    # only long texts are labelled: they are learned from
    good, bad = "The river runs past an old mill.\n" * 2500, "$$ 99 !! ## 12\n" * 2500
    model = quality.fit(docs(spark, [(i, good if i % 2 else bad) for i in range(8)]),
                        spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    a, b = model.scores([good[:500], bad[:500]])
    assert a > 0.5 > b
