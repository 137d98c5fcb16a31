"""Language identification by nearest centroid over TF-IDF n-grams.

A text becomes the counts of its byte trigrams (letters only, ASCII lower case
of the whole Unicode text, runs of anything else as one space), hashed into
``DIMS`` features. Document frequencies come from all learning rows. Each
language has several centroids, clustered by spherical k-means from a bounded,
documented sample. A text takes the language of the centroid with the highest
cosine; it is rejected when that cosine is far below what learning texts of
its length reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import filter_arrow, map_arrow, restrict, sample_ids

DIMS = 1 << 13
SAMPLE_PER_LANG = 256     # learning rows per language for the centroids
MAX_LANGS = 256
CLUSTERS = 3
SLACK = 0.5               # rejected below SLACK x the least cosine of its length class
PIECE_WORDS = (1, 2, 4, 8, 16, 32)  # short pieces of the sample tell how low short texts reach
CHUNK = 1 << 20
UNKNOWN = "und"

_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the hashed trigrams of a whole text, in chunks of
    ``CHUNK`` bytes that overlap by two."""
    data = b" " + text.lower().encode().translate(_KEEP) + b" "
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(data) - 2, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 2, len(data) - at), at).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[((b[:-2] != 32) | (b[1:-1] != 32)) & ((b[1:-1] != 32) | (b[2:] != 32))]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)
    index = np.flatnonzero(total)
    return index, total[index]


def _unit(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf[index]
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Centroids:
    """The fitted model: languages, unit centroids, idf, least cosine by length class."""

    def __init__(self, langs: list[str], owner: np.ndarray, centers: np.ndarray,
                 idf: np.ndarray, floor: np.ndarray) -> None:
        self.langs, self.owner, self.centers, self.idf, self.floor = langs, owner, centers, idf, floor

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine of its nearest centroid, rejected."""
        if not text or not _has_letter(text) or not self.langs:
            return UNKNOWN, 0.0, True
        index, count = trigram_counts(text)
        if not len(index):
            return UNKNOWN, 0.0, True
        cos = self.centers[:, index] @ _unit(index, count, self.idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[self.owner[best]], score, score <= self.floor[len(index).bit_length()]


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Unit centroids of spherical k-means; the first is the mean direction, so a
    text that no cluster is made for still finds its language."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    mean = unit(x.mean(axis=0, keepdims=True))
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = np.argmax(x @ centers.T, axis=1)
        centers = np.stack([unit(x[near == j].sum(axis=0)) if (near == j).any() else centers[j] for j in range(k)])
    return np.concatenate([mean, centers])


def fit(learn: DataFrame, per_lang: int = SAMPLE_PER_LANG, clusters: int = CLUSTERS,
        seed: int = 7) -> Centroids:
    """Fit on ``learn(doc_id, text, lang)``.

    Document frequencies read every row. Centroids read at most ``per_lang``
    rows per language. Rows with a null language or a text without letters teach
    nothing; without any learning row every text is unknown. More than
    ``MAX_LANGS`` languages raise.
    """
    learn = learn.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches):
        import pyarrow as pa
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                t = text.as_py()
                if t and _has_letter(t):
                    seen[trigram_counts(t)[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1), pa.int64()),
                                          "df": pa.array(np.append(seen[at], n), pa.int64())})

    counted = (learn.select("text").mapInArrow(frequencies, schema="feature long, df long")
               .groupBy("feature").agg(F.sum("df").alias("df")).collect())  # at most DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in counted:
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    picked = F.broadcast(sample_ids(learn, "lang", per_lang, seed).select("doc_id"))  # per_lang x languages rows

    def make():
        def step(cols):
            out = {"lang": [], "doc_id": [], "words": [], "at": [], "n": []}
            for lang, doc_id, text in zip(cols["lang"], cols["doc_id"], cols["text"]):
                words = (text or "").split()
                for size in (0, *PIECE_WORDS):
                    start = (doc_id or 0) * 7919 % max(1, len(words) - size)
                    piece = " ".join(words[start:start + size]) if size else text or ""
                    if size < len(words) and _has_letter(piece):
                        at, n = trigram_counts(piece)
                        for name, value in (("lang", lang), ("doc_id", doc_id), ("words", size),
                                            ("at", at.astype(np.int32).tobytes()), ("n", n.astype(np.int32).tobytes())):
                            out[name].append(value)
            return out
        return step

    rows = sorted(map_arrow(restrict(learn, picked), make, "lang string, doc_id long, words int, at binary, n binary")
                  .collect(), key=lambda r: (r["lang"], r["words"], r["doc_id"] or 0, r["n"]))
    langs = sorted({r["lang"] for r in rows})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the model is made for at most {MAX_LANGS}")
    rng = np.random.default_rng(seed)
    owner, centers, floors = [], [], np.full(64, np.inf)
    for k, lang in enumerate(langs):
        own = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), r["words"])
               for r in rows if r["lang"] == lang]
        own, cut = [r[:2] for r in own if r[2] == 0], [r[:2] for r in own if r[2]]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (at, n) in enumerate(own):
            x[i, at] = _unit(at, n, idf)
        made = _cluster(x, clusters, rng)
        owner += [k] * len(made)
        centers.append(made)
        for at, n in own + cut:
            size = len(at).bit_length()
            floors[size] = min(floors[size], float((made[:, at] @ _unit(at, n, idf)).max()))
    # a length class is as lenient as any longer one: shorter texts have lower cosines
    floors = np.minimum.accumulate(floors[::-1])[::-1]
    lenient = np.minimum.accumulate(np.where(np.isfinite(floors), floors, np.inf))
    floors = np.where(np.isfinite(floors), floors, lenient)
    floors = np.where(np.isfinite(floors), floors, 0.0) * SLACK
    return Centroids(langs, np.array(owner, int), np.concatenate(centers) if centers else np.zeros((0, DIMS)),
                     idf, floors)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs(doc_id, text)``.

    A null, empty or letterless text is ``und`` with score 0 and rejected.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(cols):
            found = [fitted.value.predict(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found], "rejected": [bool(f[2]) for f in found]}
        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                     "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, all columns."""
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [not fitted.value.predict(t)[2] for t in texts]

    return filter_arrow(docs, make)
