"""Language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of hashed character n-grams (1 to 3 letters, lower case, anything
but letters is one blank): the share of a bucket among all n-grams of the whole text, times its
inverse document frequency. Document frequencies are counted over all learning rows. The model is
fitted with follow-the-regularised-leader (per-coordinate rates, L1 and L2), on a sample whose size
is a parameter; a part of the sample then sets the temperature that calibrates the scores. Because
a text's score is a mean over its n-grams, prediction reads a table of bucket x language once per
n-gram and needs no feature vectors.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a
language, text or letter are not learned from; ties between languages go to the first in order; with
no learning rows every text is `und`; an empty table gives an empty result; clashing columns are
replaced; memory follows the longest text.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 3000  # learning rows that the model is fitted on, about
SCALE = 30.0
UNKNOWN = "und"
_STEP = 1 << 18
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@functools.lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each between blanks, with everything but letters one blank; where
    each text begins (one more at the end); and which texts have a letter."""
    lowered = [" " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of several blanks, the first
    keep[offsets[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    found = np.concatenate([[0], np.cumsum(letter)])[offsets]
    return np.where(letter, codes, np.uint32(32))[keep], kept[offsets], np.diff(found) > 0


def grams(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams within each text, with the text of each, in bounded steps."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for low in range(0, len(codes), _STEP):
        part = codes[low:low + _STEP + max(ORDERS) - 1].astype(A.U)
        size = min(_STEP, len(codes) - low)
        hashed = np.zeros(size, A.U)
        for order in ORDERS:
            n = max(0, min(size, len(part) - order + 1))
            hashed = hashed[:n] + part[order - 1:order - 1 + n] * A.U(_MULTIPLIERS[order - 1])
            inside = text[low:low + n] == text[low + order - 1:low + order - 1 + n]
            bucket = ((hashed + A.U(order)) * A.U(0xD6E8FEB86659FD93)) >> A.U(48)
            yield bucket[inside].astype(np.int64), text[low:low + n][inside]


@dataclasses.dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket x language, sparse by L1
    idf: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, has = letter_codes(texts)
        table = (self.idf[:, None] * self.weights * SCALE).astype(np.float64)
        sums = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        for bucket, text in grams(codes, offsets):
            count += np.bincount(text, minlength=len(texts))
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(text, table[bucket, c], minlength=len(texts))
        return sums / np.maximum(count, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, has = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return ([self.langs[b] if h else UNKNOWN for b, h in zip(best, has)],
                np.where(has, p[np.arange(len(p)), best], 0.0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Per bucket the number of texts that have it, over all rows, and the number of rows. What
    reaches the driver is one number per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, np.int64), 0
        for part, _, _ in A.portions(batches, text, 1 << 18):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            rows += len(texts)
            codes, offsets, _ = letter_codes(texts)
            seen = np.zeros((min(len(texts), 64), BUCKETS), bool)
            for low in range(0, len(texts), 64):
                seen[:] = False
                high = min(low + 64, len(texts))
                base = offsets[low]
                for bucket, owner in grams(codes[base:offsets[high]], offsets[low:high + 1] - base):
                    seen[owner, bucket] = True
                counts += seen.sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))], names=["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    rows = 0
    for bucket, n in found.collect():  # at most BUCKETS + 1 rows
        if bucket < 0:
            rows = n
        else:
            counts[bucket] = n
    return counts, rows


def vectors(sample: DataFrame, text: str, lang: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, buckets and shares of each sampled text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in A.portions(batches, text, 1 << 18):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            codes, offsets, has = letter_codes(texts)
            pairs = [owner * BUCKETS + bucket for bucket, owner in grams(codes, offsets)]
            keys, times = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
            owner = keys // BUCKETS
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            langs = part.column(part.schema.get_field_index(lang)).to_pylist()
            rows = [(langs[i], (keys[a:b] % BUCKETS).astype(np.uint16).tobytes(),
                     (times[a:b] / times[a:b].sum()).astype(np.float32).tobytes())
                    for i, (a, b) in enumerate(zip(cut, cut[1:])) if has[i]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))],
                    names=["lang", "buckets", "shares"])

    got = sample.select(text, lang).mapInArrow(run, "lang string, buckets binary, shares binary").collect()
    out = [(l, np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float32)) for l, b, s in got]
    return sorted(out, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def follow_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, *, alpha: float = 1.0,
                  beta: float = 1.0, l1: float = 0.001, l2: float = 0.001, passes: int = 4, seed: int = 7
                  ) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the multinomial loss; the last bucket is the bias, which is not penalised."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(seed)

    def solved(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at[:, None] == BUCKETS, 0.0, l1)
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(passes):
        for i in order.permutation(len(rows)):
            label, buckets, values = rows[i]
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = solved(at)
            slope = softmax(x @ w)
            slope[label] -= 1.0
            g = x[:, None] * slope
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
            n[at] = n_new
    w = solved(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search over its logarithm.

    The labels count as smoothed by one doubtful row, so that a sample without a single error does
    not make every later score 1.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    doubt = 1.0 / (len(labels) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        right = p[np.arange(len(labels)), labels]
        wrong = (p.sum(axis=1) - right) / (p.shape[1] - 1)
        return float(-((1 - doubt) * right + doubt * wrong).mean())

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE, calibrate: float = 0.2) -> Model:
    """Learn from all rows of `docs`: frequencies from every row, weights from about `sample` of
    them, spread evenly over the languages and chosen by a hash of the key and the text."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts, rows = document_frequencies(known, text)
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(BUCKETS), np.zeros(0))
    share = F.create_map(*(F.lit(x) for name in langs for x in (name, min(1.0, sample / len(langs) / sizes[name]))))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key).cast("string"), F.md5(text)), F.lit(1 << 30)) / float(1 << 30)
    idf = np.log((1 + rows) / (1 + counts)) + 1.0
    taken = vectors(known.where(draw < F.element_at(share, F.col(lang))), text, lang)
    place = {name: i for i, name in enumerate(langs)}
    examples = [(place[l], b, s * idf[b] * SCALE) for l, b, s in taken]
    shuffled = np.random.default_rng(11).permutation(len(examples))
    held = int(len(examples) * calibrate)
    fit = [examples[i] for i in shuffled[held:]]
    weights, bias = follow_leader(fit, len(langs))
    check = [examples[i] for i in shuffled[:held]]
    logits = np.array([x @ weights[b] + bias for _, b, x in check]).reshape(len(check), len(langs))
    heat = temperature_of(logits, np.array([label for label, _, _ in check], np.int64))
    return Model(langs, weights.astype(np.float32), idf.astype(np.float32), bias, heat)


def predict(docs: DataFrame, model: Model, *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The documents (without the columns in `drop`) with lang_pred and score.

    The model is sent with the tasks: BUCKETS x languages numbers, whatever the input.
    """
    gone = {"lang_pred", "score", *(d.lower() for d in drop)}
    keep = [c for c in docs.columns if c.lower() not in gone]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in A.portions(batches, text):
            langs, scores = model.predict(part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in keep),
                 pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)
