"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A bounded sample of labelled rows trains the model: hashed n-grams of 1 to 3 characters,
term frequency by text length times inverse document frequency, weights by follow-the-
regularised-leader with L1 and L2 penalties, then a temperature on a part of the sample
that the weights haven't seen. As frequencies are relative, a text's score is a mean over
its n-grams of one table row each, so whole texts are scored by lookups and sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoflux.llm import bytehash as bh

#: Labelled rows that train the model, about, and bits of n-gram hashes.
SAMPLE = 6000
BITS = 16
ORDERS = (1, 2, 3)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 30.0
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numerals such as fractions


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lowered characters of all texts, ASCII other than letters as spaces, and the end of each text."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    plain = codes < 128
    codes[plain & ((codes < 97) | (codes > 122))] = 32
    return codes, np.cumsum([len(x) for x in lowered])


def _grams(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature and place of every n-gram inside a text, order by order."""
    text_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint32)
        for i in range(order):
            h = h * np.uint32(0x01000193) ^ (codes[i : i + n] * _MULTIPLIERS[i])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(text_of[:n] == text_of[order - 1 :])
        yield (h[at] >> np.uint32(32 - BITS)).astype(np.int64), text_of[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            codes, ends = _characters([text])
            found = [f for f, _ in _grams(codes, ends)]
            if found:
                feature, count = np.unique(np.concatenate(found), return_counts=True)
                rows.append((lang, feature.astype(np.int32).tobytes(), count.astype(np.int32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["lang", "feature", "count"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: languages, table (n-grams by languages, idf times weight) and temperature, of one bounded sample."""
    rows = rows.sort_values(["lang", "feature"], ignore_index=True)
    langs = sorted(rows["lang"].unique())
    order = np.random.default_rng(7).permutation(len(rows))
    features = [np.frombuffer(x, np.int32) for x in rows["feature"]]
    counts = [np.frombuffer(x, np.int32) for x in rows["count"]]
    label = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    df = np.bincount(np.concatenate(features), minlength=1 << BITS)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 10 else set()
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    def vector(i: int) -> np.ndarray:
        return SCALE * counts[i] / counts[i].sum() * idf[features[i]]

    for _ in range(EPOCHS):
        for i in order.tolist():
            if i in held:
                continue
            f, x = features[i], vector(i)
            w = weights(f)
            g = x[:, None] * (_softmax(x @ w) - (np.arange(len(langs)) == label[i]))
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(1 << BITS))
    temperature = 1.0
    if held:
        logits = np.array([vector(i) @ w[features[i]] for i in held])
        truth = label[list(held)]
        grid = np.exp(np.linspace(-2, 3, 51))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-9)).mean() for t in grid]
        temperature = float(grid[np.flatnonzero(np.array(loss) <= min(loss) + 1e-3)[-1]])  # the least sure of the equally good
    table = (SCALE * idf[:, None] * w).astype(np.float32)
    return pd.DataFrame({"langs": [langs], "weights": [table.tobytes()], "temperature": [temperature]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Model from columns text and lang; about ``sample`` rows, as many of each language as there are, by a hash of the text.

    Of texts that repeat in a language one counts. No rows: no languages.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language, as in the model
    if not counts:
        return [], np.zeros((1 << BITS, 0), np.float32), 1.0
    shares = {lang: min(1.0, sample / len(counts) / n) for lang, n in counts.items()}
    bounds = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int(share * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(bounds, F.col("lang"))).distinct()
    counted = chosen.mapInArrow(_counted, "lang string, feature binary, count binary")
    one = counted.withColumn("sample", F.lit("all")).groupBy("sample")  # about ``sample`` rows of counts
    model = one.applyInPandas(lambda rows: train(rows), "langs array<string>, weights binary, temperature double").first()
    if model is None:
        return [], np.zeros((1 << BITS, 0), np.float32), 1.0
    return list(model["langs"]), np.frombuffer(bytes(model["weights"]), np.float32).reshape(1 << BITS, -1), model["temperature"]


OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def identify(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The language of every whole text.

    Learns from ``labelled`` (columns text, lang), by default the rows of ``docs`` whose crc32 of the
    doc_id modulo 5 is not 0. Returned, a row for each row of ``docs``: doc_id, held_out (that remainder
    is 0), lang_pred and score (calibrated probability).

    Null texts and texts without a letter: ``und`` with score 0; so is everything where nothing is labelled.
    Null languages teach nothing. Equal texts have equal results; a null doc_id counts as the empty string
    for the fold. Other columns are ignored.
    """
    langs, table, temperature = fit(labelled if labelled is not None else docs.where(~held_out()), sample)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2**BITS rows, a column for each language
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            _, offs = bh.text_bytes(batch["text"])
            best, score = [], []
            for lo, hi in bh.pieces(offs, 1 << 19):
                part = batch["text"].slice(lo, hi - lo).to_pylist()
                total, grams = np.zeros((hi - lo, len(langs))), np.zeros(hi - lo)
                codes, ends = _characters(part)
                for feature, text in _grams(codes, ends):
                    lead = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
                    if len(lead):
                        total[text[lead]] += np.add.reduceat(weights[feature], lead, axis=0, dtype=np.float64)
                        grams += np.bincount(text, minlength=hi - lo)
                known = np.array([bool(langs) and has_letter(x) for x in part])
                p = _softmax(total / np.maximum(grams, 1)[:, None] / temperature) if langs else np.zeros((hi - lo, 1))
                top = p.argmax(axis=1)
                best += [langs[t] if k else UNDETERMINED for t, k in zip(top.tolist(), known.tolist(), strict=True)]
                score += np.where(known, p[np.arange(len(top)), top], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return texts.mapInArrow(run, OUT)
