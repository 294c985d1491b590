"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read into classes. Five transducers rewrite and weigh a clause's classes: insults and
threats become hits, at most one of which a reading chooses; the target transducer accepts a hit
and makes it cheaper where somebody is addressed within ``REACH`` words, a threat only there;
negation and reported speech make a hit behind them dearer. Their composition is one machine, compiled once;
the weight of its shortest path over a clause, in the tropical semiring, is the least cost of a
toxic reading. A text's score is a calibrated function of the costs and the share of its matched clauses.
An insult that addresses nobody matches at full cost: the labels mark such clauses too.

The insults are learned from labelled rows: whole words and beginnings of words that
occur in toxic texts far more than chance allows. One text of each family of near
copies counts, so that a copied text's rare words prove nothing. The learning sample
is bounded; scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoflux.llm.storage import cut
from annoflux.llm.transducers import Transducer

#: Labelled rows that teach, about.
SAMPLE = 10_000
#: Decimal orders by which chance must be ruled out, and the share of toxic texts among those with a term.
EVIDENCE = 7.0
PRECISION = 0.95
BEGINNINGS = range(3, 9)
THRESHOLD = 0.3

# The classes' common words in four languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash clown dumb imbecile cretin".split()
THREATS = "kill hurt destroy burn shoot stab beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he she they him her them his their du ihr sie dein euch tu vous il elle ils ton tú usted él ella ellos".split()
NEGATIONS = "not no never nor isn't aren't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say told quoted wrote called reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULTED, THREATENED = range(8)
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOPS = frozenset(".!?;:\n|")

# Arc costs of the grammar in the tropical semiring.
COST = {INSULT: 1.0, THREAT: 1.6}
NEAR_TARGET, NEGATED, REPORTED = -0.4, 1.2, 0.6
REACH = 4


def _passing(symbols: tuple, state: object) -> dict:
    """Arcs that copy ``symbols`` and stay."""
    return {(state, x): [(x, 0.0, state)] for x in symbols}


def _hits(read: int, weight: float) -> Transducer:
    """Turns one of the symbols ``read`` into a hit, or none; the others become other words."""
    arcs = {}
    for state in ("none", "hit"):
        arcs |= _passing((OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULTED, THREATENED), state)
        arcs[state, read] = [(OTHER, 0.0, state)]
    arcs["none", read].append((INSULTED if read == INSULT else THREATENED, weight, "hit"))
    return Transducer("none", arcs, {"none": 0.0, "hit": 0.0})


def _addressed() -> Transducer:
    """Accepts one hit; cheaper with a target up to REACH words before or behind, and a threat only so."""
    far, arcs, final = REACH + 1, {}, {"done": 0.0}
    kinds = ((INSULTED, "insult"), (THREATENED, "threat"))
    for since in range(far + 1):  # words since a target
        for x in (OTHER, NEGATION, REPORT):
            arcs[since, x] = [(x, 0.0, min(since + 1, far))]
        arcs[since, TARGET] = [(TARGET, 0.0, 0)]
        for hit, kind in kinds:
            arcs[since, hit] = [(hit, NEAR_TARGET, "done") if since < REACH else (hit, 0.0, (kind, REACH))]
    for _, kind in kinds:
        for left in range(REACH + 1):  # words in which a target may still come
            state = (kind, left)
            for x in (OTHER, NEGATION, REPORT):
                arcs[state, x] = [(x, 0.0, (kind, max(left - 1, 0)))]
            arcs[state, TARGET] = [(TARGET, NEAR_TARGET, "done") if left else (TARGET, 0.0, state)]
            if kind == "insult":
                final[state] = 0.0
    arcs |= _passing((OTHER, TARGET, NEGATION, REPORT), "done")
    return Transducer(far, arcs, final)


def _dearer(sign: int, weight: float) -> Transducer:
    """Adds ``weight`` to a hit up to REACH words behind ``sign``."""
    far, arcs, every = REACH + 1, {}, (OTHER, TARGET, NEGATION, REPORT, INSULTED, THREATENED)
    for since in range(far + 1):
        for x in every:
            arcs[since, x] = [(x, weight if x in (INSULTED, THREATENED) and since < REACH else 0.0, min(since + 1, far))]
        arcs[since, sign] = [(sign, 0.0, 0)]
    return Transducer(far, arcs, dict.fromkeys(range(far + 1), 0.0))


@cache
def grammar() -> Transducer:
    """The composition of the five transducers over the classes of words."""
    read = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
    machine = _hits(INSULT, COST[INSULT])
    for following in (_hits(THREAT, COST[THREAT]), _addressed(), _dearer(NEGATION, NEGATED), _dearer(REPORT, REPORTED)):
        machine = following.after(machine, read).numbered()
    return machine


def clause_cost(classes: list[int]) -> float:
    """Least cost of a toxic reading of a clause; infinite without one."""
    return grammar().least(classes)


class Grammar(dict):
    """Class of a word; words are classed when first met."""

    def __init__(self, words: list[str], beginnings: list[str]):
        super().__init__()
        self.insults = frozenset([*words, *INSULTS])
        self.beginnings = frozenset(beginnings)
        self.lengths = sorted({len(x) for x in beginnings})
        self.fixed = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, word: str) -> int:
        found = self.fixed.get(word, OTHER)
        if found == OTHER and (word in self.insults or any(word[:n] in self.beginnings for n in self.lengths if len(word) >= n)):
            found = INSULT
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found

    def read(self, text: str) -> tuple[float, float, float]:
        """Features of a text: its best clause (e to the minus cost), matched clauses (damped), their share."""
        lowered = text.lower()
        hot = {INSULT, THREAT}
        if hot.isdisjoint(map(self.__getitem__, _WORD.findall(lowered))):
            return 0.0, 0.0, 0.0
        costs, clauses, classes = [], 1, []
        for token in _TOKEN.findall(lowered):
            if token in _STOPS:
                if classes:
                    costs.append(clause_cost(classes))
                    clauses += 1
                classes = []
            else:
                classes.append(self[token])
        if classes:
            costs.append(clause_cost(classes))
        matched = [x for x in costs if x < math.inf]
        if not matched:
            return 0.0, 0.0, 0.0
        return math.exp(-min(matched)), math.log1p(len(matched)), len(matched) / clauses


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash that near copies mostly share: the least of the hashes of runs of five words."""
    for batch in batches:
        family = []
        for text in batch["text"].to_pylist():
            words = text.lower().split()
            family.append(min((hash5(words[i : i + 5]) for i in range(max(1, len(words) - 4))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(family, pa.int64())], names=[*batch.schema.names, "family"])


def hash5(words: list[str]) -> int:
    data = " ".join(words).encode()
    return zlib.crc32(data) << 31 | zlib.adler32(data) >> 1


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, toxic and not, with each word (``word ``) and beginning of words."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            terms = {w + " " for w in words if len(w) > 2}
            for n in BEGINNINGS:
                terms.update(w[:n] for w in words if len(w) > n)
            (toxic if label else clean).update(terms)
    keys = list(toxic.keys() | clean.keys())
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["term", "toxic", "clean"]
        )


def choose_terms(found: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """Words and beginnings from proven (term, toxic, clean): a beginning gives way to a word that explains it, a longer one to a shorter."""
    count = {term: toxic for term, toxic, _ in found}
    words = [t[:-1] for t in count if t.endswith(" ")]
    explained: dict[str, int] = {}
    for w in words:
        for n in BEGINNINGS:
            if n < len(w):
                explained[w[:n]] = max(explained.get(w[:n], 0), count[w + " "])
    beginnings = [t for t in count if not t.endswith(" ") and explained.get(t, 0) < 0.9 * count[t]]
    every = set(beginnings)
    shortest = [t for t in beginnings if not any(t[:n] in every for n in BEGINNINGS if n < len(t))]
    known = set(shortest)
    return [w for w in words if not any(w[:n] in known for n in BEGINNINGS)], shortest


def calibrate(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights (intercept first), none negative but the intercept, by projected Newton steps."""
    x = np.c_[np.ones(len(features)), features]
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01, *[0.05] * features.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - labels) + ridge @ w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, g)
        w[1:] = np.maximum(w[1:], 0)
    return w


def fit(labelled: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Words, beginnings and weights, from columns text and toxic of a bounded sample."""
    rows = labelled.where(F.col("toxic").isNotNull() & (F.length("text") > 0)).select("text", (F.col("toxic") == 1).alias("toxic"))
    families = rows.mapInArrow(_families, "text string, toxic boolean, family long")
    one = cut(families.groupBy("family", "toxic").agg(F.min("text").alias("text")))  # the same rows for counts, terms and weights
    per_class = {bool(r["toxic"]): r["count"] for r in one.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_clean = per_class.get(True, 0), per_class.get(False, 0)
    default = np.array([-4.0, 12.0, 0.5, 0.5])
    if not n_toxic or not n_clean:
        return [], [], default
    counted = one.select("text", "toxic").mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / both
    chance = F.when(share >= 1, 0.0).otherwise((1 - share) * F.log10((1 - share) / F.lit(1 - base)))
    evidence = both * (share * F.log10(share / F.lit(base)) + chance)
    proven = counted.where((F.col("toxic") >= 3) & (share >= PRECISION)).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE)
    found = proven.orderBy(F.desc("evidence"), "term").collect()  # terms of a bounded sample
    words, beginnings = choose_terms([(r["term"], r["toxic"], r["clean"]) for r in found])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, beginnings)
        for batch in batches:
            read = np.array([grammar.read(x) for x in batch["text"].to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["toxic"], *[pa.array(read[:, i]) for i in range(3)]], names=["toxic", "best", "matched", "share"])

    seen = one.select("text", "toxic").mapInArrow(features, "toxic boolean, best double, matched double, share double")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["toxic", "best", "matched", "share"])
        return pd.DataFrame({"weights": [calibrate(frame[["best", "matched", "share"]].to_numpy(), frame["toxic"].to_numpy().astype(float)).tolist()]})

    learned = seen.withColumn("sample", F.lit("all")).groupBy("sample").applyInPandas(learn, "weights array<double>").first()
    return words, beginnings, np.array(learned["weights"]) if learned else default


OUT = "doc_id long, held_out boolean, score double, predicted int"


def _teach(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[str], list[str], np.ndarray]:
    # an id counts once, as toxic if any of its labels says so
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # about ``sample`` ids


def _read(texts: pa.Array, grammar: Grammar, weights: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for lo in range(0, len(texts), 1024):
        read = np.array([grammar.read(x or "") for x in texts.slice(lo, 1024).to_pylist()]).reshape(-1, 3)
        out.append(1 / (1 + np.exp(-np.clip(weights[0] + read @ weights[1:], -30, 30))))
    return np.concatenate(out)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every whole text of ``docs``.

    Learns from ``labels`` (doc_id, toxic) on rows whose crc32 of the doc_id modulo 4 is not 2. Returned, a row
    for each row of ``docs``: doc_id, held_out (that remainder is 2), score (0 to 1) and predicted (1 if the
    score is at least 0.3).

    Null and empty texts score like texts without a match. Null labels teach nothing; without labels of both
    kinds the fixed insults and weights hold. Of labels that repeat an id, toxic holds. Equal texts have equal scores; null ids are kept and teach
    nothing. Other columns are ignored.
    """
    words, beginnings, weights = _teach(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, beginnings)
        for batch in batches:
            p = _read(batch["text"], grammar, weights)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, OUT)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``score`` doesn't predict toxic, with all their columns; nothing is shuffled. Rows with null or empty texts stay."""
    words, beginnings, weights = _teach(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, beginnings)
        for batch in batches:
            yield batch.filter(pa.array(_read(batch["text"], grammar, weights) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
