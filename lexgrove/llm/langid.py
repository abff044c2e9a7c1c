"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all learning documents and are counted by Spark. The regression is
fitted by follow-the-regularised-leader with elastic-net penalties on a sample of at most
`per_lang` documents of each language, then calibrated by a temperature on a part of the sample
that the fit didn't see. Every whole text is scored by the weights it gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANG = 1000
MAX_GRAMS = 20_000_000  # of the whole sample, 6 bytes each on the driver
SCALE = 100.0  # of a gram's share of the text, so that the penalties meet values near 1
CHUNK = 1_000_000  # code points that are scored together
_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point -> lower case letter; 32 for all that is no letter."""
    global _fold
    if _fold is None:
        fold = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                low = c.lower()
                fold[cp] = ord(low[0])
        _fold = fold
    return _fold


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts and lengths of the padded texts, a bucket for each position and order, and whether each has a letter.

    A gram that would leave its text gets bucket BUCKETS, which weighs nothing.
    """
    padded = [f" {t} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    cps = _folded()[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = np.add.reduceat(cps != 32, starts) > 0
    ends, out = starts + lengths, []
    for n in ORDERS:
        h = cps * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h[:-k] = (h[:-k] ^ cps[k:]) * np.uint32(0x85EBCA6B + 2 * k)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(16)
        for k in range(1, n):
            h[np.maximum(ends - k, starts)] = BUCKETS
        out.append(h)
    return starts, lengths, out, letters


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _total(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's document frequency by bucket, and under -1 and -2 its documents and their distinct grams by language."""
    df, langs, sizes = np.zeros(BUCKETS + 1, np.int64), {}, {}
    for b in batches:
        for t, lang in zip(b["_text"].to_pylist(), b["_lang"].to_pylist(), strict=True):
            langs[lang] = langs.get(lang, 0) + 1
            seen = np.zeros(BUCKETS + 1, bool)
            for h in _grams([t])[2]:
                seen[h] = True
            df += seen
            sizes[lang] = sizes.get(lang, 0) + int(np.count_nonzero(seen[:BUCKETS]))
    at = np.flatnonzero(df[:BUCKETS])
    bucket = np.concatenate((at, np.full(len(langs), -1), np.full(len(sizes), -2)))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "lang": pa.array([None] * len(at) + list(langs) + list(sizes), pa.string()), "n": pa.array([*df[at].tolist(), *langs.values(), *sizes.values()], pa.int64())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, tf = [], []
        for t in b["_text"].to_pylist():
            _, lengths, grams, _ = _grams([t])
            n = np.bincount(np.concatenate(grams), minlength=BUCKETS + 1)[:BUCKETS]
            own = np.flatnonzero(n)
            at.append(own.astype("<u2").tobytes())
            tf.append((n[own] / _total(lengths)[0]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": b["_lang"], "at": pa.array(at, pa.binary()), "tf": pa.array(tf, pa.binary())})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (BUCKETS + 1, n_langs) from sparse rows (buckets, values, language) by FTRL-proximal; many are exactly 0."""
    z, n = np.zeros((BUCKETS + 1, n_langs)), np.zeros((BUCKETS + 1, n_langs))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


class Model:
    """Languages, weights that include the inverse document frequencies, and the temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, temperature: float) -> None:
        self.langs, self.weights, self.temperature = langs, weights.astype(np.float32), temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, score
        for a, b in _chunks([t or "" for t in texts]):
            starts, lengths, grams, letters = _grams([t or "" for t in texts[a:b]])
            logits = np.zeros((b - a, len(self.langs)))
            for h in grams:
                for k in range(len(self.langs)):
                    logits[:, k] += np.add.reduceat(self.weights[:, k].take(h), starts, dtype=np.float64)
            p = _softmax(logits / _total(lengths)[:, None] / self.temperature)
            best = p.argmax(axis=1)
            for i in np.flatnonzero(letters):
                out[a + i], score[a + i] = self.langs[best[i]], p[i, best[i]]
        return out, score


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 by 3; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_grams: int = MAX_GRAMS) -> Model:
    """Learns from documents that aren't held out and have a language and a text.

    The sample for the regression is chosen by a hash of id and text. It is bounded: per_lang
    rows of a language, as expected and twice that in all cases for all languages together, or
    fewer if languages are so many or texts so long that it would have over max_grams different
    grams, as expected. Document frequencies have no bound. Without such rows the model knows no
    language and predicts `und`.
    """
    own = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    found = own.select("_text", "_lang").mapInArrow(_frequencies, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    by_lang, grams_of = ({r.lang: r.n for r in found[found.bucket == k].itertuples()} for k in (-1, -2))
    langs = sorted(by_lang)
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0)), 1.0)
    df, grams = np.zeros(BUCKETS + 1), found[found.bucket >= 0]
    df[grams.bucket.to_numpy()] = grams.n.to_numpy()
    idf = np.where(df > 0, np.log((1 + sum(by_lang.values())) / (1 + df)) + 1, 0.0)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / by_lang[k], max_grams / len(langs) / max(1, grams_of[k])))))
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = own.where(draw < share[F.col("_lang")]).limit(2 * per_lang * len(langs)).select("_text", "_lang").mapInArrow(_counted, "lang string, at binary, tf binary").collect()
    rows = sorted(((r.lang, bytes(r["at"]), bytes(r["tf"])) for r in sample))
    ready = [(a := np.frombuffer(at, "<u2"), SCALE * np.frombuffer(tf, "<f4") * idf[a], langs.index(lang)) for lang, at, tf in rows]
    check, learn = ready[::5], [r for i, r in enumerate(ready) if i % 5] or ready
    w = ftrl(learn, len(langs))
    logits, y = np.array([x @ w[a] for a, x, _ in check]), np.array([y for *_, y in check])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    return Model(langs, SCALE * w * idf[:, None], float(min(np.geomspace(0.05, 5, 60), key=loss)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred, score.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if the model knows
    no language. Repeated rows get the same answer; ties between languages go to the first by
    name; own columns named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    d = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = d.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return d.mapInArrow(run, schema)
