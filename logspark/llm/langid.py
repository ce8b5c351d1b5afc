"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (n = 1..3, blended) present in both,
normalised by the numbers of their own. N-grams are known exactly: three code points of 21 bits
fit a 64-bit integer. A bounded sample of labelled documents trains one-versus-rest kernel ridge
regression on the Nystroem features of a smaller set of landmark texts, taken whole. A batch's
margins are the product of its n-gram presence, the landmarks' presence and the weights; the last
two do not depend on the batch, so they are multiplied once, and a batch takes one sparse product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_of
from .words import pack, unpack

UNKNOWN = "und"
FOLDS = 5
#: Bits of a code point, the longest n-gram, and the code of what stands between letters.
POINT, LONGEST, GAP = 21, 3, 1
#: Margins become shares by a softmax of this steepness.
STEEPNESS = 4.0
#: Weights that are summed at once.
CELLS = 1 << 22


@dataclass(frozen=True)
class Settings:
    #: Labelled documents and landmarks of each language, at most; landmarks in all (but two of every language).
    sample: int = 250
    landmarks: int = 24
    all_landmarks: int = 2_000
    ridge: float = 1e-3


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # n-grams of the landmarks, sorted
    weights: np.ndarray  # grams x languages: the landmarks' presence times the weights of their kernel values
    bias: np.ndarray


_LETTER: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with each run of other characters than letters as one GAP; empty if there is no letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(65536)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[0][np.minimum(points, 65535)]
    beyond = points > 65535
    if beyond.any():
        rare, place = np.unique(points[beyond], return_inverse=True)
        letter[beyond] = np.array([chr(c).isalpha() for c in rare.tolist()])[place]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, points, GAP)[keep].astype(np.uint64)


def grams_of(text: str) -> np.ndarray:
    """The distinct n-grams of a text, sorted: the integers of n code points do not meet those of another n, as no code is 0."""
    known = codes(text)
    each, h = [known], known
    for n in range(2, LONGEST + 1):
        h = (h[:-1] << np.uint64(POINT)) | known[n - 1 :]
        each.append(h)
    return np.unique(np.concatenate(each))


def _postings(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all n-grams of the landmarks, sorted; where each one's landmarks begin, and the end; landmarks of n-gram after n-gram)."""
    every, owner = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    return grams, np.append(first, len(every)), owner[order]


def _shared(text: np.ndarray, grams: np.ndarray, first: np.ndarray, owner: np.ndarray, landmarks: int) -> np.ndarray:
    """How many n-grams a text shares with each landmark."""
    at = _places(text, grams)
    sizes = first[at + 1] - first[at]
    steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.bincount(owner[np.repeat(first[at], sizes) + steps], minlength=landmarks).astype(np.float64)


def _places(text: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(grams, text), len(grams) - 1)
    return at[grams[at] == text]


def train(sample: dict[str, list[np.ndarray]], s: Settings | None = None) -> Model:
    """A model of the languages of sample (language -> n-grams of texts, in a fixed order)."""
    s = s or Settings()
    languages = sorted(k for k, v in sample.items() if any(len(g) for g in v))
    texts = [g for k in languages for g in sample[k][: s.sample] if len(g)]
    owner = np.array([i for i, k in enumerate(languages) for g in sample[k][: s.sample] if len(g)], dtype=np.int64)
    if not texts:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    each = min(s.landmarks, max(2, s.all_landmarks // len(languages)))
    chosen = [j for i in range(len(languages)) for j in np.flatnonzero(owner == i)[:each]]
    grams, first, held = _postings([texts[j] for j in chosen])
    shared = np.stack([_shared(t, grams, first, held, len(chosen)) for t in texts])
    sizes = np.array([len(t) for t in texts], dtype=np.float64)
    cross = shared / np.sqrt(sizes[:, None] * sizes[None, chosen])
    # Nystroem: features K_nm W^(-1/2), and ridge regression on them for each language against the rest
    values, vectors = np.linalg.eigh(cross[chosen])
    keep = values > values.max() * 1e-7
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = cross @ root
    mean = features.mean(axis=0)
    targets = np.where(owner[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(owner)[owner] * len(owner) / len(languages)  # languages count alike
    centred = features - mean
    gram = (centred * weight[:, None]).T @ centred + s.ridge * len(owner) * np.eye(features.shape[1])
    level = (targets * weight[:, None]).sum(axis=0) / weight.sum()
    beta = np.linalg.solve(gram, (centred * weight[:, None]).T @ (targets - level))
    of_landmark = (root @ beta) / np.sqrt(sizes[chosen])[:, None]
    weights = np.add.reduceat(of_landmark[held], first[:-1], axis=0)
    return Model(languages, grams, weights.astype(np.float32), (level - mean @ beta).astype(np.float32))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """(language, score) of each text; the score turns margins into a share of 0 to 1."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    found = [grams_of(t) if t else np.zeros(0, np.uint64) for t in texts]
    with_letters = [i for i, g in enumerate(found) if len(g)]
    if not with_letters:
        return names, scores
    places = [_places(found[i], model.grams) for i in with_letters]
    # presence by weights: rows of the weights summed, so many at once that they stay small whatever the number of languages
    once = max(1, CELLS // len(model.languages))
    sums = np.zeros((len(with_letters), len(model.languages)))
    for i, own in enumerate(places):
        for at in range(0, len(own), once):
            sums[i] += model.weights[own[at : at + once]].sum(axis=0, dtype=np.float64)
    margin = sums / np.sqrt([len(found[i]) for i in with_letters])[:, None] + model.bias
    share = np.exp(STEEPNESS * (margin - margin.max(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = margin.argmax(axis=1)
    for i, b, p in zip(with_letters, best.tolist(), share[np.arange(len(best)), best].tolist(), strict=True):
        names[i], scores[i] = model.languages[b], p
    return names, scores


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [pack(grams_of(t), delta=True) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["lang", "o", "grams"])


def labelled_sample(docs: DataFrame, s: Settings) -> dict[str, list[np.ndarray]]:
    """N-grams of at most s.sample texts of each language, those of the least hashes of doc_id and text; documents of fold 0 are held out.

    Only the n-grams of about twice the sample reach the driver, however the rows repeat.
    """
    train_rows = docs.filter((crc_mod("doc_id", FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = train_rows.groupBy("lang").count().collect()
    if not sizes:
        return {}
    spark, space = docs.sparkSession, 1 << 40
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(space))
    # a first cut by hash, of some more rows than are wanted, so that little is moved
    cut = spark.createDataFrame([(r["lang"], min(space, int((1.5 * s.sample + 40) / r["count"] * space))) for r in sizes], "lang string, cut long")
    rows = train_rows.select("lang", order.alias("o"), "text").join(F.broadcast(cut), "lang").filter("o < cut").select("lang", "o", "text")
    found = rows.mapInArrow(_sampled, "lang string, o long, grams binary").dropDuplicates(["lang", "o"]).collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["o"])):
        out.setdefault(r["lang"], []).append(unpack(r["grams"], np.uint64, delta=True))
    return {k: v[: s.sample] for k, v in out.items()}


def identify_languages(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Trains on a bounded sample of the documents that are not held out; only texts are inputs of a
    prediction, and they are scored whole. A null text, or one without a letter, is 'und' with
    score 0, and so is every text if nothing is labelled. Repeated rows are alike. Other columns
    are ignored.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(train(labelled_sample(docs, s), s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                names, scores = predict(batch.column(2).to_pylist(), known.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
