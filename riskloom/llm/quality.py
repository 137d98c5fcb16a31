"""Document quality from a linear-chain CRF over lines.

Every line is good or bad. Its evidence is a vector of counts of its own and of
the lines before and after it; a 2 x 2 transition matrix ties neighbours. The
CRF is trained by exact gradients (forward-backward) on a bounded sample of
labelled documents, whose lines all carry the label of their document. The
quality of a document is the mean of the marginals of its lines, weighted by
their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import map_arrow, sample_ids

SAMPLE_PER_LABEL = 3000   # labelled documents per label, for training only
SAMPLE_LINES = 2000       # lines of a piece of text that the model learns from
SAMPLE_CHARS = 200_000    # and its characters
SAMPLE_PIECES = 4         # pieces of a longer document, spread over all of it
EPOCHS = 40
BATCH = 256

# byte classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence marks, 5 other marks, 6 beyond ASCII
_CLASS = np.array([6 if b >= 0x80 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit()
                   else 3 if chr(b).isspace() else 4 if chr(b) in ".,;:?'\"()-" else 5 for b in range(256)], np.uint8)
N_CLASSES = 7
N_OWN = 2 * N_CLASSES + 11
N_FEATURES = 3 * N_OWN + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, with those of its neighbours; weight of each line)."""
    raw = text.encode()
    b = np.frombuffer(raw + b"\n", np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    kind = _CLASS[b]
    share = np.empty((len(ends), N_CLASSES))
    for k in range(N_CLASSES):
        share[:, k] = np.add.reduceat((kind == k).astype(np.int32), starts)
    share[:, 3] -= 1  # the line break itself
    share /= np.maximum(size, 1)[:, None]
    lines = raw.split(b"\n")
    own = np.zeros((len(ends), N_OWN))
    own[:, :N_CLASSES] = share
    own[:, N_CLASSES:2 * N_CLASSES] = share > 0.08
    words = np.empty(len(lines))
    alike = np.empty(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w)
        alike[i] = len(set(w))
    same = np.maximum(words, 1)
    f = 2 * N_CLASSES
    own[:, f] = np.log1p(size) / 5
    own[:, f + 1] = np.log1p(words) / 4
    own[:, f + 2] = alike / same                                # 1: no word twice
    own[:, f + 3] = np.where(words > 20, alike / same, 1.0)
    own[:, f + 4] = np.minimum(size / same, 20) / 10            # length of a word
    own[:, f + 5] = size == 0
    own[:, f + 6] = words < 4
    own[:, f + 7] = words < 12
    own[:, f + 8] = len(lines) == 1
    own[:, f + 9] = np.log1p(words.sum()) / 8
    own[:, f + 10] = words.sum() < 30
    zero = np.zeros((1, N_OWN))
    n = len(lines)
    edge = np.zeros((n, 3))
    edge[0, 0] = edge[-1, 1] = edge[:, 2] = 1
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), edge]), np.maximum(size, 1)


def _packed(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences padded to the longest: (documents, lines, ...) and the mask."""
    longest = max(len(d) for d in docs)
    out = np.zeros((len(docs), longest, *docs[0].shape[1:]))
    mask = np.zeros((len(docs), longest), bool)
    for i, d in enumerate(docs):
        out[i, :len(d)] = d
        mask[i, :len(d)] = True
    return out, mask


def marginals(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on padded chains. ``emit``: (documents, lines) log-odds of
    good. Returns P(good) per line and the expected count of each transition."""
    n, longest = emit.shape
    psi = np.zeros((n, longest, 2))
    psi[..., 1] = np.clip(emit, -30, 30)
    psi = np.exp(psi - psi.max(axis=2, keepdims=True))
    move = np.exp(trans - trans.max())
    fwd, bwd = np.empty_like(psi), np.ones_like(psi)
    fwd[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        a = (fwd[:, t - 1] @ move) * psi[:, t]
        fwd[:, t] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), fwd[:, t - 1])
    for t in range(longest - 2, -1, -1):
        b = (bwd[:, t + 1] * psi[:, t + 1]) @ move.T
        bwd[:, t] = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    p = fwd * bwd
    p /= p.sum(axis=2, keepdims=True)
    pair = fwd[:, :-1, :, None] * move * (psi[:, 1:] * bwd[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p[..., 1], (pair * mask[:, 1:, None, None]).sum(axis=(0, 1))


class LineCrf:
    def __init__(self, mean, scale, weight, trans, slope, shift) -> None:
        self.mean, self.scale, self.weight, self.trans = mean, scale, weight, trans
        self.slope, self.shift = slope, shift

    def line_share(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the marginals of each text. Texts of like line
        counts are padded together."""
        out = np.empty(len(texts))
        feats = [line_features(t) for t in texts]
        emit = [((x - self.mean) / self.scale) @ self.weight for x, _ in feats]
        order = sorted(range(len(texts)), key=lambda i: len(emit[i]))
        at = 0
        while at < len(order):
            limit = 2 * len(emit[order[at]]) + 8
            group = [i for i in order[at:at + BATCH] if len(emit[i]) <= limit]
            e, mask = _packed([emit[i] for i in group])
            p, _ = marginals(e, mask, self.trans)
            for row, i in zip(p, group):
                w = feats[i][1]
                out[i] = float(row[:len(w)] @ w / w.sum())
            at += len(group)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        p = np.clip(self.line_share(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> LineCrf:
    """Maximise the likelihood of the line labels by Adam; documents weigh alike,
    whatever their number of lines. The document score is calibrated at the end."""
    feats = [line_features(t)[0] for t in texts]
    y = np.array(labels, float)
    stacked = np.vstack(feats) if feats else np.zeros((1, N_FEATURES))
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0  # the constant
    feats = [(x - mean) / scale for x in feats]
    weight, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    model = LineCrf(mean, scale, weight, trans, 1.0, 0.0)
    if len(set(labels)) < 2:
        model.weight[-1] = 8.0 if labels and labels[0] == 1 else -8.0 if labels else 0.0
        return model
    rng = np.random.default_rng(seed)
    params = np.zeros(N_FEATURES + 4)
    m, v, t = np.zeros_like(params), np.zeros_like(params), 0
    by_size = np.argsort([len(x) for x in feats], kind="stable")
    batches = [by_size[i:i + 64] for i in range(0, len(by_size), 64)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            idx = batches[k]
            x, mask = _packed([feats[i] for i in idx])
            p, moved = marginals(x @ params[:N_FEATURES], mask, params[N_FEATURES:].reshape(2, 2))
            share = 1 / mask.sum(axis=1)
            gap = np.where(mask, y[idx][:, None] - p, 0.0) * share[:, None]
            grad = np.zeros_like(params)
            grad[:N_FEATURES] = np.einsum("dl,dlf->f", gap, x) / len(idx)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[idx].astype(int), y[idx].astype(int)), mask.sum(axis=1) - 1)
            grad[N_FEATURES:] = ((seen - moved) / max(mask.sum(), 1)).ravel()
            grad -= 1e-4 * params
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            params += 0.03 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    model.weight, model.trans = params[:N_FEATURES].copy(), params[N_FEATURES:].reshape(2, 2).copy()
    share = np.clip(model.line_share(texts), 1e-6, 1 - 1e-6)
    z = np.log(share / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logit
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        h = np.array([[np.sum(w * z * z) + 1, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
        a, b = np.array([a, b]) + np.linalg.solve(h, [np.sum((y - q) * z) - (a - 1), np.sum(y - q)])
    model.slope, model.shift = max(a, 1e-3), b
    return model


def sample_pieces(text: str) -> list[str]:
    """What the model learns from of one document: the text, or of a longer one
    ``SAMPLE_PIECES`` runs of whole lines, spread evenly from its start to its end. A
    line of more than ``SAMPLE_CHARS`` is cut there."""
    cuts, at, lines = [0], 0, 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        end = min(end, at + SAMPLE_CHARS)
        if lines == SAMPLE_LINES or end - cuts[-1] > SAMPLE_CHARS:
            cuts.append(at)
            lines = 0
        at, lines = end, lines + 1
    spans = list(zip(cuts, cuts[1:] + [len(text)]))
    if len(spans) > SAMPLE_PIECES:
        spans = [spans[round(i * (len(spans) - 1) / (SAMPLE_PIECES - 1))] for i in range(SAMPLE_PIECES)]
    return [text[a:b].removesuffix("\n") if b < len(text) else text[a:b] for a, b in spans]


def _pieces(rows: DataFrame) -> DataFrame:
    def make():
        def step(cols):
            found = [(d, p, q) for d, t, q in zip(cols["doc_id"], cols["text"], cols["stratum"]) for p in sample_pieces(t)]
            return {"doc_id": [f[0] for f in found], "text": [f[1] for f in found], "stratum": [f[2] for f in found]}
        return step

    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("stratum").cast("int").alias("stratum")),
                     make, "doc_id long, text string, stratum int")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, seed: int = 7) -> LineCrf:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``; at most
    ``per_label`` documents per label, of long ones a few pieces. Rows without a label teach nothing; without
    two labels every text gets the same score."""
    marked = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    known = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = sample_ids(known, "quality", per_label, seed)  # at most 2 x per_label rows
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(picked), "doc_id"))
    found = sorted({(r["doc_id"], r["text"], r["stratum"]) for r in _pieces(rows).collect()})
    return train([t for _, t, _ in found], [q for _, _, q in found], seed=seed)


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs(doc_id, text)``.

    A null or empty text is one empty line and is scored like any other.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(cols):
            s = fitted.value.scores([t or "" for t in cols["text"]])
            return {"doc_id": cols["doc_id"], "score": s.tolist(), "predicted": [int(x >= 0.5) for x in s]}
        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                     "doc_id long, score double, predicted int")
