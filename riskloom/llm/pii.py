"""Personal data: exact base patterns plus spans found by a character model.

Base spans follow the stated patterns. The model (``charmodel.Tagger``) is
trained from labelled spans: the base spans of a bounded sample of documents,
and the same spans with other letters and digits, rewritten as people disguise them
("name [at] host [dot] org", a national phone number without its plus) and set
between other words. Training ends when windows held out of it are read right, or
after ``TRAIN_STEPS``.

The model reads every place of a text where a span can lie that passes the check
of its kind: such a span holds a digit, an at-sign or a spelled-out at between
what can be a name and a host, so the windows are cut from all stretches within
``REACH`` of such a mark, and longer stretches become windows that overlap by
half. A number is no longer than ``REACH``; an address may be, and then has a
window of its own, up to ``LONGEST`` on either side of its at. What the windows say is reconciled for
the whole text: a span cut by an inner window edge is left to the next window,
and among overlapping candidates the set with the greatest total posterior
wins. A span that the model adds must also pass the check of its kind once
spelled-out marks are put back; base spans always stay.
"""

from __future__ import annotations

import pickle
import random
import re
from bisect import bisect_right
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.charmodel import Tagger
from riskloom.llm.shared import map_arrow, restrict, sample_ids

KINDS = ("email", "ip", "card", "phone")
REACH = 64
LONGEST = 320             # characters of an address on one side of its at, spelled-out dots included
MARGIN = 16
WINDOW = 2 * REACH
SAMPLE_DOCS = 1500        # documents with candidates that teach the model
SAMPLE_WINDOWS = 4        # windows taken of each
SHARES = (5, 1, 1, 3)     # of the lessons, by kind: more for what is written in more forms
LESSONS = 24_000          # windows made of those with spans reworded
TRAIN_STEPS = 1000        # at most; training ends when held-out windows are read right
HELD_SHARE = 10           # one of so many sampled windows is held out of training

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGN = re.compile(r"[0-9@]")
_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?|\sat\s", re.I)
_DOT = re.compile(r"\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s", re.I)
_SPELLED = re.compile(r"[\[(]\s?(?:at|dot)\s?[\])]|\bdot\b|(?<=[\w.%+\-\])])\sat\s(?=[a-z0-9-]++(?:\.|" + _DOT.pattern + r")[a-z0-9-])", re.I)
_ANY_AT = re.compile("@|" + _AT.pattern, re.I)
_NAME = re.compile(r"(?:[a-z0-9._%+-]|" + _DOT.pattern + r")+\Z", re.I)
_HOST = re.compile(r"(?:[a-z0-9.-]|" + _DOT.pattern + r")+", re.I)
_EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_WHOLE = re.compile(r"\(?[0-9]++\)?(?:[\x20.-]?\(?[0-9]++\)?)*")


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    """Within a maximal run of dotted numbers the matches are its groups of four."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the stated patterns, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] + [(s, 1, e) for s, e in _ips(text)]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text)
              if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal stretches within ``REACH`` of a character that a span can hold."""
    marks = [m.start() for m in _SIGN.finditer(text)]
    low = text.lower()
    if "dot" in low or "at" in low:
        marks = sorted(marks + [m.start() for m in _SPELLED.finditer(text)])
    out: list[tuple[int, int]] = []
    for at in marks:
        s, e = max(0, at - REACH), min(len(text), at + REACH)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def windows(text: str) -> list[tuple[int, int, bool, bool]]:
    """(start, end, left edge is inner, right edge is inner), overlapping by half."""
    out = []
    for s, e in stretches(text):
        at = s
        while True:
            end = min(e, at + WINDOW)
            out.append((at, end, at > s, end < e))
            if end == e:
                break
            at += WINDOW // 2
    for s, e in long_addresses(text):
        out.append((s, e, s > 0, e < len(text)))
    return out


def long_addresses(text: str) -> list[tuple[int, int]]:
    """What can be an address of over ``REACH`` characters, with a margin."""
    if "@" not in text and "at" not in text.lower():
        return []
    out = []
    for m in _ANY_AT.finditer(text):
        host = _HOST.match(text, m.end(), min(len(text), m.end() + LONGEST))
        if host is None or not re.search(r"\.|dot", host[0], re.I):
            continue
        low = max(0, m.start() - LONGEST)
        at = m.start()  # the name is matched from the left end of the run that holds it
        while at > low and (text[at - 1] in _LOCAL or text[at - 1] in "[]()" or text[at - 1].isspace()):
            at -= 1
        name = _NAME.search(text[at:m.start()])
        if name and host.end() - (at + name.start()) > REACH:
            out.append((max(0, at + name.start() - MARGIN), min(len(text), host.end() + MARGIN)))
    return out


def genuine(kind: int, span: str) -> bool:
    """Whether a span the model proposes is of its kind once its marks are put back."""
    if kind == 0:
        return bool(_EMAIL_WHOLE.fullmatch(_DOT.sub(".", _AT.sub("@", span))))
    if kind == 1:
        return any((s, e) == (0, len(span)) for s, e in _ips(span))
    if kind == 2:
        return bool(_CARD.fullmatch(span)) and 12 <= len(d := _digits(span)) <= 19 and luhn(d)
    return bool(_PHONE_WHOLE.fullmatch(span)) and 9 <= len(_digits(span)) <= 15


def reconcile(candidates: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the non-overlapping set with the greatest total weight."""
    best: dict[tuple[int, int, int], float] = {}
    for s, e, kind, w in candidates:
        best[s, e, kind] = max(w, best.get((s, e, kind), 0.0))
    rows = sorted(((e, s, k, w) for (s, e, k), w in best.items()))
    ends = [r[0] for r in rows]
    total, take = [0.0], []
    for i, (e, s, k, w) in enumerate(rows):
        j = bisect_right(ends, s, 0, i)
        take.append(j if total[j] + w > total[i] else None)
        total.append(max(total[i], total[j] + w))
    out, i = [], len(rows)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            e, s, k, _ = rows[i - 1]
            out.append((s, k, e))
            i = take[i - 1]
    return out[::-1]


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled and verified spans of the model for each whole text."""
    cut = [windows(t) for t in texts]
    pieces = [t[s:e] for t, ws in zip(texts, cut) for s, e, _, _ in ws]
    decoded = iter(model.decode(pieces) if pieces else [])
    out = []
    for text, ws in zip(texts, cut):
        cand = []
        for s, e, left, right in ws:
            for kind, a, b, weight in next(decoded):
                if (left and a == 0) or (right and s + b == e):
                    continue  # the neighbouring window has it whole
                if kind == 3 and (text[s + a - 1:s + a].isalnum() or text[s + b:s + b + 1].isalnum()):
                    continue  # part of a longer word
                if genuine(kind, text[s + a:s + b]):
                    cand.append((s + a, s + b, kind, weight))
        out.append(reconcile(cand))
    return out


# The marks by which people write an address, plain ones included.
AT_FORMS = ("@", " [at] ", " (at) ", "[at]", "(at)", " at ")
DOT_FORMS = (".", " [dot] ", " (dot) ", "[dot]", "(dot)", " dot ")
PHONE_FORMS = ("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "({0}){1}-{2}", "{0}{1}{2}")


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(words: list[str], rng: random.Random) -> str:
    return rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz")
                                                                for _ in range(rng.randint(1, 9)))


def reworded(kind: int, span: str, words: list[str], rng: random.Random) -> str | None:
    """The span with other letters and digits, in one of the forms people write it in;
    None if that is no span of its kind."""
    if kind == 0:
        name, host = span.split("@")
        if rng.random() < 0.7:
            name = rng.choice("._-").join(_word(words, rng) for _ in range(rng.randint(1, 3)))
            name += _number(rng, rng.choice([0, 0, 1, 2, 4]))
        if rng.random() < 0.7:
            labels = [rng.choice(["-", ""]).join(_word(words, rng) for _ in range(rng.choice([1, 1, 2])))
                      for _ in range(rng.randint(1, 2))]
            host = ".".join([*labels, _word(words, rng)[:rng.randint(2, 4)]])
        at, dot = rng.choice(AT_FORMS), rng.choice(DOT_FORMS)
        if rng.random() < 0.5:
            name = name.replace(".", dot)
        new = name + at + host.replace(".", dot)
        new = new.upper() if rng.random() < 0.1 else new
    elif kind == 1:
        new = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == 2:
        n = len(_digits(span))
        body = _number(rng, n - 1)
        digits = iter(body + next(c for c in "0123456789" if luhn(body + c)))
        new = "".join(next(digits) if c in "0123456789" else c for c in span)
    elif rng.random() < 0.15:
        new = re.sub("[0-9]", lambda _: rng.choice("0123456789"), span)
        return new if _PHONE.fullmatch(new) else None
    else:
        new = rng.choice(PHONE_FORMS).format(_number(rng, 3), _number(rng, 3), _number(rng, 4))
    return new if genuine(kind, new) else None


def harmless(rng: random.Random) -> str:
    """A date, time, amount, count or key, which is no span of any kind."""
    own = rng.randint(1900, 2050)
    year, month, day = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    clock = f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}"
    return rng.choice([
        f"{year}-{month:02}-{day:02}", f"{year}-{month:02}-{day:02} {clock}", f"{day:02}.{month:02}.{year}",
        f"{month}/{day}/{year}", clock, f"{year}", f"{year}-{year + 1}",
        f"{own} {own + rng.randint(1, 9)} {own + rng.randint(10, 19)}", f"ISBN 978-{rng.randint(0, 9)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}",
        f"{rng.randint(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"{rng.randint(0, 99)}.{_number(rng, rng.randint(1, 3))}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        _number(rng, rng.randint(1, 8)), _number(rng, rng.randint(20, 40)), "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))),
        f"@{''.join(rng.choice('abcdefghij') for _ in range(5))}", f"at {clock}", f"at {_number(rng, 2)} dot"])


def _placed(window: str, taken: list[tuple[int, int, int]], new: str, rng: random.Random):
    """``new`` in a gap between words of the window: (text, spans, start), or None without a gap."""
    gaps = [m.start() for m in re.finditer(" ", window) if not any(s <= m.start() < e for s, _, e in taken)]
    gaps += [i for i in (0, len(window)) if not any(s < i < e for s, _, e in taken)]
    if not gaps:
        return None
    at = rng.choice(gaps)
    before = rng.choice([" ", " ", " ", ": ", " (", "\n"]) if at else ""
    after = rng.choice([" ", " ", " ", ". ", ", ", ") ", "\n"]) if at < len(window) else rng.choice(["", "", ".", " "])
    rest = window[at:].lstrip(" ")
    start = at + len(before)
    shift = start + len(new) + len(after) - (len(window) - len(rest))
    moved = [(s, k, e) if e <= at else (s + shift, k, e + shift) for s, k, e in taken]
    return window[:at] + before + new + after + rest, moved, start


def _cropped(text: str, spans: list[tuple[int, int, int]], lo: int, hi: int):
    """The text from ``lo`` to ``hi``, moved outward where that would cut a span."""
    lo = min([s for s, _, e in spans if s < lo < e], default=lo)
    hi = max([e for s, _, e in spans if s < hi < e], default=hi)
    return text[lo:hi], [(k, s - lo, e - lo) for s, k, e in spans if lo <= s and e <= hi]


def lessons(rows: list[str], seed: int = 7, size: int = LESSONS):
    """Training windows and their spans: as found, and about ``size`` more, by the
    ``SHARES`` of their kinds, in which a span is reworded, where it stood or between words of any window,
    with more or less of the text around it; every fifth holds a harmless number instead."""
    rng = random.Random(seed)
    texts, spans = [], []
    clear: dict[str, list[tuple[int, int, int]]] = {}
    by_kind: dict[int, list[tuple[str, tuple[int, int, int]]]] = {}
    for window in rows:
        own = base_spans(window)
        clear[window] = [(s, k, e) for i, (s, k, e) in enumerate(own)
                         if all(e <= o[0] or o[2] <= s for j, o in enumerate(own) if j < i)]
        texts.append(window)
        spans.append([(k, s, e) for s, k, e in clear[window]])
        for span in clear[window]:
            by_kind.setdefault(span[1], []).append((window, span))
    words = sorted({w.lower() for row in rows for w in re.findall("[A-Za-z]{2,10}", row)}) or ["a"]
    kinds = [k for k in sorted(by_kind) for _ in range(SHARES[k])]
    for i in range(size if kinds else 0):
        kind = kinds[i % len(kinds)]
        window, (s, _, e) = rng.choice(by_kind[kind])
        new = harmless(rng) if i % 5 == 4 else reworded(kind, window[s:e], words, rng)
        if new is None:
            continue
        if i % 5 != 4 and rng.random() < 0.3:
            shift = len(new) - (e - s)
            text = window[:s] + new + window[e:]
            held = [(a, k, b) if b <= s else (a + shift, k, b + shift) for a, k, b in clear[window] if (a, b) != (s, e)]
            start = s
        else:
            place = rng.choice(rows)
            found = _placed(place, clear[place], new, rng)
            if found is None:
                continue
            text, held, start = found
        if i % 5 != 4:
            held = sorted([*held, (start, kind, start + len(new))])
        else:
            held = sorted(held)
        lo, hi = max(0, start - rng.randint(0, REACH // 2)), min(len(text), start + len(new) + rng.randint(0, REACH // 2))
        text, held = _cropped(text, held, lo, hi)
        texts.append(text)
        spans.append(held)
    return texts, spans


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = TRAIN_STEPS, seed: int = 7) -> Tagger | None:
    """Train on at most ``sample_docs`` documents that hold candidates, at most
    ``SAMPLE_WINDOWS`` windows of each. None if no document holds a candidate."""
    some = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    ids = F.broadcast(sample_ids(some.select("doc_id", F.lit(0).alias("all")), "all", sample_docs, seed)
                      .select("doc_id"))

    def make():
        def step(cols):
            out = []
            for d, t in zip(cols["doc_id"], cols["text"]):
                ws = windows(t)
                own = base_spans(t)
                cuts = lambda at: any(s < at < e for s, _, e in own)
                ws = [w for w in ws if not cuts(w[0]) and not cuts(w[1])]
                random.Random(f"{seed}:{d}").shuffle(ws)
                out += [t[s:e] for s, e, _, _ in ws[:SAMPLE_WINDOWS]]
            return {"piece": out}
        return step

    def teach(batches):
        pieces = sorted({p for batch in batches for p in batch.column("piece").to_pylist()})
        if pieces:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(trained(pieces, steps, seed))]})

    # training is one task on an executor: at most sample_docs * SAMPLE_WINDOWS windows
    pieces = map_arrow(restrict(some, ids), make, "piece string").distinct().repartition(1)
    made = pieces.mapInArrow(teach, schema="model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def trained(pieces: list[str], steps: int = TRAIN_STEPS, seed: int = 7, size: int = LESSONS) -> Tagger:
    """A model taught by ``lessons`` of the windows, every ``HELD_SHARE``-th of which is held out."""
    model = Tagger(KINDS, seed)
    apart = len(pieces) >= 2 * HELD_SHARE
    held = lessons(pieces[::HELD_SHARE], seed + 1, size // 40) if apart else None
    own = lessons([p for i, p in enumerate(pieces) if i % HELD_SHARE or not apart], seed, size)
    model.train(*own, steps, seed=seed, held=held)
    return model


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``; see ``op3`` for the columns.

    A null or empty text has no span. Repeated rows give repeated results, an
    empty table gives no rows. Positions are code points of the whole text.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(cols):
            texts = [t or "" for t in cols["text"]]
            base = [base_spans(t) for t in texts]
            more = model_spans(fitted.value, texts) if fitted.value is not None else [[] for _ in texts]
            everything, added = [], []
            for own, extra in zip(base, more):
                extra = [(s, k, e) for s, k, e in extra if all(e <= o[0] or o[2] <= s for o in own)]
                added.append(len(extra))
                everything.append(sorted(own + extra))
            n = [[sum(k == kind for _, k, _ in own) for own in base] for kind in range(len(KINDS))]
            return {"doc_id": cols["doc_id"], "n_email": n[0], "n_ip": n[1], "n_card": n[2], "n_phone": n[3],
                    "base_sha256": [sha256(_joined(b).encode()).hexdigest() for b in base],
                    "spans": [_joined(x) for x in everything], "n_added": added}
        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                     "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                     "spans string, n_added long", rows_per_step=512)
