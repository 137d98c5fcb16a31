"""Fill-in-middle, hard negatives and SimHash against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from riskloom.llm import fim, hard_negatives, ngram_join, simhash
from tests.llm.helpers import CLASH, awkward, docs

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------ fill in middle

def brute_fim(doc_id, text):
    units = UNITS.findall(text or "")
    n, text = len(units), text or ""
    h = [int(sha(f"42:{'null' if doc_id is None else doc_id}")[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def random_text(rng):
    return "".join(rng.choice(["a", "bc", " ", "\n", "\t ", "é", "漢字", "😀", "<", "<P", "M>", "x", " "])
                   for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 4096])
def test_cuts_match_brute_force(block):
    rng = random.Random(block)
    for doc_id in range(400):
        text = random_text(rng)
        assert fim.cut_text(doc_id, text, block=block) == brute_fim(doc_id, text)


def test_descent_matches_running_sums():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 13, 64, 100):
        counts = rng.integers(0, 4, (n, 2))
        tree = fim.Fenwick(counts)
        run = np.concatenate([[0], np.cumsum(counts[:, 0])])
        chars = np.concatenate([[0], np.cumsum(counts[:, 1])])
        for k in range(1, run[-1] + 1):
            at = int(np.searchsorted(run, k)) - 1
            got, before = tree.descend(k, 0)
            assert (got, before.tolist()) == (at, [run[at], chars[at]])


def test_transform_and_report(spark):
    rng = random.Random(1)
    rows = awkward() + [(100 + i, random_text(rng)) for i in range(200)] + [(7, "holds <M> a mark"), (500, " \n")]
    source = docs(spark, rows, clash=True)
    key = lambda r: repr(tuple(r))
    want = sorted(((r[0], *brute_fim(r[0], r[1])) for r in rows), key=key)
    assert sorted(map(tuple, fim.transform(source).collect()), key=key) == want
    texts = sorted(((r[0], sha(brute_fim(r[0], r[1])[4]), sha(r[1] or "")) for r in rows), key=key)
    got = fim.report(source)
    assert sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in got.collect()), key=key) == texts
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.report(docs(spark, [])).count() == 0


def test_long_text():
    text = "".join(f"wörd{i % 977} \n" for i in range(400_000))
    assert fim.cut_text(2, text) == brute_fim(2, text)


# ------------------------------------------------------------ hard negatives

EMB = "vec_id long, embedding array<float>, label int"


def brute_mine(rows):
    part = []
    for at, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        part.append((at, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    last = lambda i: (i is None, i or 0)
    out = []
    for at, anchor, label, v in part:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), i, l) for k, i, l, w in part if k != at),
                        key=lambda r: r[:2])
        for s, _, positive, _ in [r for r in scored if r[3] == label][:5]:
            ok = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s]
            out += [(anchor, positive, k + 1, r[2], -s, -r[0]) for k, r in enumerate(ok[:5])]
    return out


def vectors(rng, n, dims, spread):
    return [(int(rng.integers(0, 1200)), [float(np.float32(x)) for x in rng.normal(0, spread, dims) + 0.2],
             int(rng.integers(0, 10))) for _ in range(n)]


def mined(spark, rows, clash=False, **kw):
    df = spark.createDataFrame(rows, EMB)
    if clash:
        for i, name in enumerate(CLASH):
            if name != "label":
                df = df.selectExpr("*", f"'{i}' AS `{name}`")
    got = hard_negatives.mine(df, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 1), (8, 127), (9, 128), (64, 300), (20, 1 << 20)):
        c, a = rng.integers(-most, most + 1, (50, dims)), rng.integers(-most, most + 1, (7, dims))
        planes = hard_negatives.bit_planes(c)
        kind = hard_negatives._sum_type(a, planes.shape[1])
        assert np.array_equal(hard_negatives.scores(planes, hard_negatives.subset_sums(a, kind)), c @ a.T)


def test_mining_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(100 * i, *r[1:]) for i, r in enumerate(vectors(rng, 8, 12, 0.4))] + vectors(rng, 500, 12, 0.4)
    rows += [(None, rows[0][1], 3), (None, rows[1][1], 4), (3, None, 1), (4, rows[0][1], None), (100, [float("nan")] * 12, 1),
             (5, [None] + rows[0][1][1:], 2), (6, [float("inf")] * 12, 2), (200, rows[2][1], 5), (200, rows[2][1], 5),
             (11, [], 3), (400, rows[3][1][:5], 1), (13, [9.0] * 15, 2)]
    want = sorted(brute_mine(rows), key=repr)
    assert len(want) > 100
    assert mined(spark, rows, clash=True) == want
    assert mined(spark, rows, anchor_bytes=600) == want    # blocks of about two anchors


def test_ties_and_copies(spark):
    same = [0.5] * 8
    rows = [(i, same, i % 3) for i in range(1, 400)] + [(0, same, 1)]
    assert mined(spark, rows) == sorted(brute_mine(rows), key=repr)


def test_mining_without_partners(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []      # no anchor
    low = [(100, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]        # a positive of negative score
    assert mined(spark, low) == sorted(brute_mine(low)) == []


# ------------------------------------------------------------------- SimHash

def brute_fingerprint(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, budget=3):
    """items: (doc, fingerprint); the least reachable doc for each item, null last."""
    rank = lambda d: (d is None, d or 0)
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if items[i][0] == items[j][0] or (items[i][1] ^ items[j][1]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), doc), doc, key=rank)
    return [least[find(i)] for i in range(len(items))]


def test_fingerprints_match_definition(monkeypatch):
    rng = random.Random(4)
    texts = [r[1] for r in awkward() if len(r[1] or "") < 10_000]
    texts += [" ".join(rng.choice(["The", "é", "b\tc", "漢", "x y", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "CHUNK", 5)
    assert [simhash.fingerprint(t) for t in texts] == want
    # Spark's own hash of a string is the same function with the same seed
    assert simhash.fingerprint("one") == xxhash.xxh64_intdigest(b"one", 42)


def cloud(rng, n, centres, most):
    """Fingerprints scattered around centres: links, chains and near misses."""
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("pairs", [1 << 16, 8, 1])
def test_descent_in_small_steps(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "DIRECT", 16 if pairs > 1 else 1)
    for seed in range(8):
        rng = random.Random(seed)
        some = sorted(set(cloud(rng, 200, [rng.getrandbits(64) for _ in range(5)], 6) + [0, 1, (1 << 64) - 1]))
        none = np.zeros(len(some), np.int64)
        i, j = simhash.joined(none, np.array(some, np.uint64), none, 3)
        got = list(range(len(some)))
        for a, b in zip(i.tolist(), j.tolist()):
            got[a] = b                       # the first of its component
        assert got == brute_components(list(enumerate(some)))


@pytest.mark.parametrize("limit,step,run", [(1 << 17, 4, 1 << 17), (20, 4, 50), (4, 24, 1)])
def test_trie_join_matches_brute_force(spark, monkeypatch, limit, step, run):
    monkeypatch.setattr(simhash, "STEP", step)
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(6)]
    some = sorted(set(cloud(rng, 260, centres, 6) + [rng.getrandbits(64) for _ in range(40)] + [0, 1, (1 << 64) - 1]))
    items = list(enumerate(some))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in items]
    edges = simhash.links(spark.createDataFrame(signed, "node long, fp long"), 3, limit, run).collect()
    want = brute_components(items)
    root = list(range(len(some)))
    for _ in range(len(some)):
        before = list(root)
        for r in edges:
            root[r["a"]] = root[r["b"]] = min(root[r["a"]], root[r["b"]])
        if before == root:
            break
    assert root == want


@pytest.mark.parametrize("budget", [0, 1, 2, 5])
def test_other_budgets(spark, budget):
    rng = random.Random(budget)
    some = sorted(set(cloud(rng, 120, [rng.getrandbits(64) for _ in range(3)], budget + 3)))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(some)]
    edges = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "node long, fp long"), budget).collect()}
    got = list(range(len(some)))
    for _ in some:
        for a, b in edges:
            got[a] = got[b] = min(got[a], got[b])
    assert got == brute_components(list(enumerate(some)), budget)


@pytest.mark.parametrize("hot_parts", [1, 2000])
def test_near_duplicates_match_brute_force(spark, monkeypatch, hot_parts):
    monkeypatch.setattr(simhash, "HOT_PARTS", hot_parts)
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(120)] for _ in range(6)]
    rows = [r for r in awkward()]
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(105, "another text of a known id"), (None, " ".join(base[0]))]
    items = [(r[0], simhash.fingerprint(r[1])) for r in rows]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(items, brute_components(items))]
    got = simhash.near_duplicates(docs(spark, rows, clash=True))
    assert got.columns == ["doc_id", "fingerprint", "component_id", "copy_id"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_hot_tokens_make_the_same_tiles(spark):
    rng = random.Random(12)
    held = {(n, rng.choice([1, 2, rng.randint(3, 40)])) for n in range(60) for _ in range(4)}  # tokens 1 and 2 are hot
    tokens = spark.createDataFrame(sorted(held), "node long, token long")
    sizes = spark.createDataFrame([(n, 20 + n % 9) for n in range(60)], "node long, size long")
    calm, some, every = (sorted(map(tuple, ngram_join._tiles(tokens, sizes, 85, parts).collect())) for parts in (1, 8, 10 ** 6))
    assert calm == some == every and len(calm) > 60
    assert ngram_join._tiles(tokens.limit(0), sizes, 85).count() == 0
