"""Token counts, personal data, page text, decontamination: against libraries and brute force."""

import random
import re

import pytest

from riskloom.llm import bpe_count, decontaminate, html_main, pii
from riskloom.llm.charmodel import Tagger
from tests.llm.helpers import awkward, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


# -- token counts -----------------------------------------------------------
def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer
    rng = random.Random(3)
    alphabet = "ab e'sThll0129 \n\t.,-é漢😀 ​<|>"
    rows = awkward() + [(300 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    rows += [(500, "x" * 40_000), (501, "ab<|endoftext|> c<|endoftext|><|endoftext|>"), (502, "<|endoftext")]
    got = bpe_count.token_counts(docs(spark, rows, clash=True), VOCAB)
    library = Tokenizer.from_file(VOCAB)
    want = []
    for r in rows:
        t = r[1] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((r[0], len(t.encode()), n, n > 1024))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe_count.token_counts(docs(spark, []), VOCAB).count() == 0


def test_merging_by_heap_equals_merging_by_scan():
    table = bpe_count.MergeTable(open(VOCAB, encoding="utf-8").read())
    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choice(b"aethinos .\xc3\xa9") for _ in range(rng.randint(1, 30)))
        symbols = [table.first[b] for b in piece]
        while True:
            ranked = [(table.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in table.rank]
            if not ranked:
                break
            rank, i = min(ranked)
            symbols[i:i + 2] = [table.made[rank]]
        assert table.pieces(piece) == len(symbols)


# -- personal data ------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 3 and not 9 <= len(digits) <= 15
                    or kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("a.@1+ -_%0(29)b.@5") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), t
    long_run = "1" * 200_000 + "a" * 200_000 + "@"
    assert pii.base_spans(long_run) == []  # and in linear time


def test_windows_cover_every_candidate():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("abc 1@.") if rng.random() < 0.1 else "x" for _ in range(rng.randint(0, 900)))
        cut = pii.windows(t)
        for i, c in enumerate(t):
            if c in "1@":
                assert any(s <= i < e for s, e, _, _ in cut)
        for a in range(0, max(0, len(t) - pii.REACH), 7):  # any place of a span lies whole in one window
            b = a + pii.REACH - 1
            if any(ch in "1@" for ch in t[a:b]):
                assert any(s <= a and b <= e for s, e, _, _ in cut)


def test_windows_hold_every_genuine_form():
    filler = "some plain words of a text without any number or sign in them " * 6
    forms = [(0, "jane at example.com"), (0, "jane.doe at mail dot example dot com"), (0, "JANE\tAT\tEXAMPLE.COM"), (0, "jane [at] x [dot] org"),
             (0, "jane (at\t) x.org"), (0, "a" * 60 + " [at] " + " [dot] ".join(["departments" * 2] * 5)), (0, "x (dot) at y.org"),
             (3, "(212)555-0199"), (3, "2125550199"), (3, "(212) 555-0199"), (3, "212 555 0199")]
    for kind, span in forms:
        assert pii.genuine(kind, span), span
        for text in (filler + span + " " + filler, span, f"mail {span}, now"):
            at = text.index(span)
            assert any(s <= at - l and at + len(span) + r <= e for s, e, left, right in pii.windows(text)
                       for l, r in [(int(left), int(right))]), span
    assert pii.windows(filler + "we met at noon. Then at home") == []
    assert not pii.genuine(3, "1" * 5000) and not pii.genuine(3, "12345678") and not pii.genuine(3, "212--5550199")


def test_reconcile_takes_the_heaviest_set():
    rng = random.Random(7)
    for _ in range(200):
        cand = [(s, s + rng.randint(1, 8), rng.randint(0, 3), rng.random()) for s in
                (rng.randint(0, 20) for _ in range(rng.randint(0, 8)))]
        got = pii.reconcile(cand)
        best = 0.0
        for mask in range(1 << len(cand)):
            pick = [c for i, c in enumerate(cand) if mask >> i & 1]
            if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(pick) for b in pick[:i]):
                best = max(best, sum(c[3] for c in pick))
        weight = {}
        for s, e, k, w in cand:
            weight[s, k, e] = max(w, weight.get((s, k, e), 0))
        assert abs(sum(weight[g] for g in got) - best) < 1e-9


def test_tagger_gradient_and_marginals():
    import numpy as np
    model = Tagger(("x",), seed=1)
    texts, spans = ["ab1cd", "12"], [[(0, 2, 4)], []]
    ids, length = model.pack(texts)

    def loss():
        score, _ = model._forward(ids, length)
        total = 0.0
        for row, n in enumerate(length):
            move = model.p["trans"] + model.allowed
            gold = np.zeros(n, int)
            for k, s, e in spans[row]:
                gold[s:e] = 2
                gold[s] = 1
            paths, own = [], None
            for code in range(model.n_tags ** n):
                tags = [code // model.n_tags ** i % model.n_tags for i in range(n)]
                v = model.first[tags[0]] + sum(score[row, i, t] for i, t in enumerate(tags))
                v += sum(move[a, b] for a, b in zip(tags, tags[1:]))
                paths.append(v)
                own = v if tags == gold.tolist() else own
            top = max(paths)
            total += top + np.log(sum(np.exp(p - top) for p in paths)) - own
        return total

    score, cache = model._forward(ids, length, keep=True)
    marginal, _ = model._posterior(score, length)
    assert np.allclose(marginal.sum(axis=2)[np.arange(5)[None] < length[:, None]], 1)
    gold = np.zeros(ids.shape, int)
    gold[0, 2:4] = [1, 2]
    live = np.arange(ids.shape[1])[None] < length[:, None]
    grad = model._backward(ids, cache, (marginal - np.eye(model.n_tags)[gold]) * live[..., None])
    for name in ("emb", "wx", "wh", "b", "out", "ob"):
        flat = model.p[name].reshape(-1)
        for at in np.argsort(-np.abs(grad[name].reshape(-1)))[:3]:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[at]) < 1e-4


def _personal(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice("the river runs past an old mill quiet people keep bees".split()) for _ in range(20)]
        d = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(d + c for c in "0123456789" if pii.luhn(d + c))
        datum = [f"ann.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
                 ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
                 f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"][i % 4]
        words.insert(rng.randint(0, 20), datum)
        out.append((i, " ".join(words)))
    return out


def test_lessons_mark_their_spans():
    texts, spans = pii.lessons([t for _, t in _personal(60, 3)], size=3000)
    assert len(texts) > 2500 and sum(len(x) > 1 for x in spans) > 100 and sum(not x for x in spans) > 50
    for text, marked in zip(texts, spans):
        # each is a span of its kind when read alone
        assert all(pii.genuine(k, text[s:e]) or (0, k, e - s) in pii.base_spans(text[s:e]) for k, s, e in marked), (text, marked)
        assert all(a[2] <= b[1] for a, b in zip(marked, marked[1:]))
    assert pii.lessons(["no span at all"], size=50) == (["no span at all"], [[]])


def test_personal_data_end_to_end(spark):
    source = docs(spark, _personal(240, 8) + awkward(), clash=True)
    model = pii.fit(source, steps=250)
    rows = [(1000, "mail jan.doe [at] mail7 [dot] example [dot] com please"), (1001, "a clean text, 2024 and 3.5 only"),
            (1002, None), (1003, "x@y.org"), (1003, "x@y.org"), (1004, "token = 9868c1b2aa70011")]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows, clash=True), model).collect()}
    assert got[1000]["spans"].startswith("email:5:") and got[1000]["n_email"] == 0
    assert got[1001]["spans"] == "" == got[1002]["spans"] == got[1004]["spans"]
    assert got[1003]["spans"] == "email:0:7" and got[1003]["n_email"] == 1
    assert pii.find(docs(spark, rows), model).count() == len(rows)
    # base spans always stay, whatever the model says
    everything = pii.find(source, model).collect()
    texts = {i: t for i, t in _personal(240, 8)}
    for r in everything:
        if r["doc_id"] in texts and r["doc_id"] >= 20:
            base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(texts[r["doc_id"]])}
            assert base and base <= set(r["spans"].split(","))
    assert pii.fit(docs(spark, [(1, "no candidates here")])) is None
    assert pii.find(docs(spark, []), None).count() == 0


# -- page text ----------------------------------------------------------------
PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "1 AS page", "'y' AS blocks")


def test_article_of_a_marked_page(spark):
    html = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>menu</ul></nav>"
            "<header>top</header><article class='post'><header><h1>Big &amp; bold</h1></header><p>One <b>two<br>three"
            "<p>f&ocirc;ur\n five<div class='share-box'>share me</div><form>name <input></form><p>Of.</p>"
            "<section id=comments><p>I disagree</p></section></article><aside>side</aside><footer>&copy; x</footer>")
    rows = [(1, "http://h/1", html), (1, "http://h/1", html), (2, None, None), (3, "http://h/3", ""), (None, "http://h/4", "plain text")]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    assert got[1, "http://h/1"] == "Big & bold One two three fôur five Of."
    assert got[2, None] == "" == got[3, "http://h/3"] and got[None, "http://h/4"] == "plain text"
    assert html_main.extract(pages(spark, rows)).count() == len(rows)
    assert html_main.extract(pages(spark, [])).count() == 0


def test_recurring_subtrees_go_and_copies_count_once(spark):
    def html(i):
        return (f"<body><div><div>Site name</div><span>Since 1999</span></div><div><p>Story {i} starts.</p><p>Of.</p>"
                f"<p>It ends {i}.</p></div><div>All <i>rights</i> reserved</div></body>")
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", html(7)) for i in range(12)]  # copies of one page: no template
    rows += [(200 + i, f"http://c.example/{i}", html(i)) for i in range(3)]   # too few pages
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} starts. It ends {i}." for i in range(12))
    assert got[105] == "Site name Since 1999 Story 7 starts. Of. It ends 7. All rights reserved"
    assert got[200] == "Site name Since 1999 Story 0 starts. Of. It ends 0. All rights reserved"


def test_counts_decide_inside_and_outside_articles(spark):
    def html(i):
        return (f"<body><div>Plain text number {i} beside a teaser.</div><article class=card><h3>Teaser</h3>Read it</article>"
                f"<main><p>Story {i} has its own words.</p><p>Get our letter every week, it is free</p>"
                f"<p>{'Of.' if i % 2 else 'So it is.'}</p></main><script>var nonce={i}</script></body>")
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", html(7).replace("nonce=7", f"nonce={i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    # a short paragraph on half of the pages is a chance repeat (the guard), one on every page is template
    assert all(got[i] == f"Plain text number {i} beside a teaser. Story {i} has its own words. {'Of.' if i % 2 else 'So it is.'}"
               for i in range(12))
    assert got[105] == ("Plain text number 7 beside a teaser. Teaser Read it Story 7 has its own words. "
                        "Get our letter every week, it is free Of.")


def test_template_of_a_section_or_of_many_pages(spark):
    def html(i, extra):
        return f"<body><p>Story {i} has its own words.</p>{extra}<p>It ends {i}.</p></body>"
    rows = [(i, f"http://a.example/{'news' if i < 12 else 'shop'}/{i}", html(i, "<div>All news</div>" if i < 12 else ""))
            for i in range(40)]  # 30 % of the host, all of a section
    rows += [(1000 + i, f"http://b.example/{i}.html", html(i, "<div>Buy now</div>" if i % 10 < 3 else "<p>So.</p>" if i % 10 < 6 else ""))
             for i in range(400)]  # 30 % of a host without sections
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} has its own words. It ends {i}." for i in range(40))
    assert all(got[1000 + i] == f"Story {i} has its own words. {'So. ' if 3 <= i % 10 < 6 else ''}It ends {i}." for i in range(400))


def test_lines_that_some_articles_share_stay(spark):
    line = "A sentence that several articles happen to share."
    rows = [(i, f"http://a.example/news/{i}", f"<article><h1>Story {i}</h1>{f'<p>{line}</p>' if i < 6 else ''}<p>Words of {i}.</p></article>")
            for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} {line + ' ' if i < 6 else ''}Words of {i}." for i in range(10))


def test_class_words_on_wrappers_drop_nothing():
    text = lambda html: " ".join(html_main.parse(html)[0])
    for wrapper in ("<body class='page no-sidebar'><article>{}</article>", "<body class=sidebar><main>{}</main>",
                    "<div id='content' class='has-sidebar'><p>{}</p></div>", "<article class='post comments-open'>{}</article>",
                    "<article class=notice><p>{}</p></article>", "<div class=comments><div class=ad><article>{}</article></div></div>",
                    "<div class='sidebar'>{}<main>x</main></div>"):
        assert "all of it" in text(wrapper.format("all of it")), wrapper
    for wrapper in ("<div class='share-box'>{}</div>", "<div class='x ad'><p>{}</p></div>", "<section id=comments><p>{}</section>",
                    "<div id='cookie_notice'>{}</div>", "a <span class=ad>{}</span> b", "<div class='menu list'>{}</div>"):
        assert "all of it" not in text(f"<article>text</article>{wrapper.format('all of it')}<p>end"), wrapper
        assert text(f"<article>text</article>{wrapper.format('all of it')}<p>end").endswith("end")
    # the comments' own articles are not the page's
    assert text("<article>text</article><div class=comments><article>I disagree</article></div>") == "text"
    blocks, inside, trees = html_main.parse("<div><p>a</p><div class=ad><p>b</p><p>c</p></div><p>d</p></div>")
    assert blocks == ["a", "d"] and len(inside) == 2 and sorted(t[1:] for t in trees) == [(0, 1), (0, 2), (1, 2)]


def test_formulas_and_drawings_keep_their_text():
    text = lambda html: " ".join(html_main.parse(html)[0])
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math>"
    assert text(f"<p>Energy is {formula} here</p>") == "Energy is E=m here"
    assert text("<p>See <svg><title>icon</title><path d='M0'/><text>Fig. 1</text></svg> there") == "See Fig. 1 there"
    assert text("<p>See <svg aria-hidden=true><text>x</text></svg> there") == "See there"


def test_subtree_hashes_follow_tag_and_text():
    of = lambda html: {t[1:]: t[0] for t in html_main.parse(html)[2]}
    a, b = of("<div><p>one</p><p>two</p></div><div><p>x</p></div>"), of("<h1>top</h1><div><p>one</p><i>a</i><p>two</p></div>")
    c = of("<h1>top</h1><div class=k><p>one</p><p>two</p></div><section><p>one</p><p>two</p></section>")
    assert a[0, 2] != a[2, 3] and of("<div>a</div>") != of("<p>a</p>")
    assert c[1, 3] == a[0, 2] != c[3, 5] and a[0, 2] not in b.values()
    assert of("<div><p>one</p><div class=ad>x<p>y</p></div><p>two</p></div>")[0, 2] == a[0, 2]  # what is dropped leaves no trace


def test_shapes_follow_tags_and_classes_without_text():
    of = lambda html: {t[1:]: t[0] for t in html_main.read(html)[3]}
    article = "<article><h1>t</h1><div class=x>story</div></article>"
    a = of(f"<div class='top p1'><ul><li><a>one</a><li><a>two</a></ul></div>{article}<div>bare</div>")
    b = of(f"<div class='p2 top'><ul><li><a>three</a></ul></div>{article}<div class=x>end</div>")
    assert set(a) == {(0, 2)} and set(b) == {(0, 1), (3, 4)}  # the inner list spans the same blocks
    assert a[0, 2] == b[0, 1] != b[3, 4]
    shapes = lambda html: [t[1:] for t in html_main.read(html)[3]]
    assert shapes(f"<div class=w>{article}<div class=k>x</div></div>") == [(2, 3)]
    # without an article the core is the smallest element with most of the text
    page = "<div class=k>ab</div><div class=w><div class=k>abcdefghij</div><p>klm</p></div>"
    assert shapes(page) == [(0, 1)] and shapes(page.replace("ab<", "abcdefghij<")) == []
    assert html_main.read("<nav><ul><li>x</ul></nav><p>y")[0] == ["y"]
    assert html_main.read("<nav><ul><li>x</ul></nav><p>y", lists=False)[0] == ["x", "y"]


def test_menus_with_new_words_on_every_page_go_by_their_shape(spark):
    def html(i):
        links = "".join(f"<li><a href=/{i}-{k}>word{i}x{k}</a></li>" for k in range(3 + i % 3))
        return (f"<body><div class=top{i}><ul>{links}</ul></div><div class=offer>Buy {i} now</div>"
                f"<article><div class=lead>Story {i} starts.</div><p>It ends {i}.</p></article><div>Plain {i}</div>"
                f"<site-foot>Line {i}</site-foot></body>")
    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(12)]
    rows += [(200 + i, f"http://c.example/{i}", html(i)) for i in range(3)]  # too few pages
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} starts. It ends {i}. Plain {i}" for i in range(12))
    assert got[200] == "word0x0 word0x1 word0x2 Buy 0 now Story 0 starts. It ends 0. Plain 0 Line 0"


@pytest.mark.parametrize("lists", [True, False])
def test_counts_equal_brute_force(spark, lists):
    rng = random.Random(12)
    parts = ["<div class=k>{}</div>", "<p>{}</p>", "<div><ul><li>{}<li>x</ul></div>", "<nav><ul><li>{}</ul></nav>",
             "<section class='ad'>{}</section>", "<div>{}</div>"]
    rows = []
    for i in range(160):
        inner = lambda n: "".join(rng.choice(parts).format(rng.choice(["same", "also", f"new {rng.random()}"]))
                                  for _ in range(rng.randint(0, n)))
        body = f"<article><p>Story {rng.randint(0, 90)}</p>{inner(2)}</article>" if i % 4 else f"<div>{'long ' * 30}{i}</div>"
        rows.append((i, f"http://h{min(rng.randint(0, 9), 4)}.example/{rng.choice('ab')}/{i}", f"<body>{inner(3)}{body}{inner(2)}"))
    rows += [(500, rows[0][1], rows[0][2]), (501, None, None)]
    read = {html: html_main.read(html or "", lists) for _, _, html in rows}
    places = {}
    for _, url, html in rows:
        host, section = (url.split("/")[2], url.split("/")[3]) if url else ("", "")
        for place in ((host,), (host, section)):
            said = tuple(read[html][0])
            places.setdefault(place, {}).setdefault(said, set()).update(t[0] for t in read[html][2] + read[html][3])
    want = {}
    for page_id, url, html in rows:
        host, section = (url.split("/")[2], url.split("/")[3]) if url else ("", "")
        blocks, _, trees, shapes = read[html]
        keep = [True] * len(blocks)
        for h, s, e in trees + shapes:
            for place in ((host,), (host, section)):
                n, of = sum(h in held for held in places[place].values()), len(places[place])
                if n >= 4 and (n >= (0.8 if h & 2 else 0.3) * of or len(place) == 1 and n >= 20 and not h & 1):
                    keep[s:e] = [False] * (e - s)
        want[page_id] = " ".join(b for b, k in zip(blocks, keep) if k)
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages(spark, rows), 4, 0.3, 20, lists).collect()}
    assert got == want
    assert sum(want[p] != " ".join(read[h][0]) for p, _, h in rows) > 50


def test_deep_nesting_is_read_in_time():
    n = 200_000
    blocks, _, trees = html_main.parse("<div>" * n + "end" + "</p></div>" * n)
    assert blocks == ["end"] and len(trees) == n
    blocks, _, trees = html_main.parse("<div>a" * n)
    assert len(blocks) == n and len(trees) == n


def test_broken_markup_does_not_crash():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div class=\"a", "\">", "<li>", "</ul>", "text", "&amp;", "<", ">", "<!--", "-->", "<b>", "</b>",
             "<article>", "</article>", "<td>", "<tr>", "</div>", "<script>", "</script>", "<br/>", "'", "<aside hidden>", "<h1>"]
    for _ in range(5000):
        blocks, inside, trees = html_main.parse("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
        assert len(blocks) == len(inside) and all(0 <= s < e <= len(blocks) for _, s, e in trees)


# -- decontamination --------------------------------------------------------------
def substring_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(10)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.least_distance(item, decontaminate.char_masks(item), text) == substring_distance(item, text)


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_matches_equal_brute_force(spark, block_bytes):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(10)).capitalize()) for i in range(8)]
    items += [(8, None), (9, ""), (10, "short"), (11, items[0][1]), (0, items[0][1])]
    rows = awkward()
    for i in range(120):
        base = items[rng.randint(0, 7)][1]
        for _ in range(rng.randint(0, 7)):
            at = rng.randint(0, len(base) - 1)
            base = base[:at] + rng.choice(["", "x", "xy", " "]) + base[at + rng.randint(0, 1):]
        rows.append((400 + i, f"{word()} {word()}\n{base.upper() if i % 3 else base}  {word()}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in
           decontaminate.matches(docs(spark, rows, clash=True), bench, block_bytes=block_bytes).collect()}
    want = {}
    for r in rows:
        if len(r[1] or "") > 5000:
            continue
        for item_id, text in items:
            item = decontaminate.normal(text)
            if len(item) >= decontaminate.MIN_CHARS:
                d = substring_distance(item, decontaminate.normal(r[1]))
                if d <= int(len(item) * decontaminate.ERROR_RATE):
                    want[r[0], item_id] = d
    assert got == want and len({d for d in want.values()}) > 2
    left = decontaminate.clean(docs(spark, rows, clash=True), bench, block_bytes=block_bytes)
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted(
        (r[0] for r in rows if r[0] not in {d for d, _ in want}), key=repr)


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "an item long enough to be matched")], "item_id long, text string")
    none = bench.limit(0)
    assert decontaminate.matches(docs(spark, []), bench).count() == 0
    assert decontaminate.matches(docs(spark, awkward()), none).count() == 0
    assert decontaminate.clean(docs(spark, awkward()), none).count() == len(awkward())


def test_short_items_are_found_whole_and_exactly(spark):
    items = [(1, "What is 2 + 2?"), (2, "中国首都是哪里"), (3, "one"), (4, " \n")]
    rows = [(1, "so, what is  2 + 2? Four"), (2, "somewhat is 2 + 2?"), (3, "问题：中国首都是哪里呢"), (4, "none of the ones"),
            (5, "(One)"), (6, "what is 2 - 2?"), (7, "none, then one"), (8, "")]
    got = sorted(map(tuple, decontaminate.matches(
        docs(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == [(1, 1, 0), (3, 2, 0), (5, 3, 0), (7, 3, 0)]
