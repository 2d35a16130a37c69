"""Toxicity (operator 10): maximum-scoring segments over token log-odds with Dirichlet priors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, Shared, give_back, sub_batches

TOKEN = re.compile(r"\w+")
EULER = 0.5772156649015329


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def name(word: str) -> str:
    """What stands for the word in tables: the word, or its beginning and a digest if it has over 64 letters."""
    return word if len(word) <= 64 else f"{word[:24]}#{hashlib.sha256(word.encode()).hexdigest()[:24]}"


def stems(word: str) -> list[str]:
    """The word's beginnings of 6, 5 and 4 letters, which stand in for words that are too rare."""
    return [word[:k] + "*" for k in (6, 5, 4) if len(word) > k]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = 0.5, sure: float = 2.8, least: float = 1.5) -> np.ndarray:
    """Log-odds of each token for toxic against clean documents, with a Dirichlet prior of ``prior`` documents
    for each token; 0 where it is less than ``sure`` standard errors, or than ``least``, from 0."""
    y1, y0 = toxic + prior, clean + prior
    d = np.log(y1 / (n_toxic + 2 * prior)) - np.log(y0 / (n_clean + 2 * prior))
    return np.where((np.abs(d) >= sure * np.sqrt(1 / y1 + 1 / y0)) & (np.abs(d) >= least), d, 0.0)


class Weights(dict):
    """Token -> weight: its own, or that of its longest known beginning, or 0.  Starts anew when it is full."""

    def __init__(self, known: dict[str, float], room: int) -> None:
        super().__init__()
        self.known, self.room = known, room

    def __missing__(self, word: str) -> float:
        w = next((self.known[x] for x in (name(word), *stems(word)) if x in self.known), 0.0)
        if len(word) <= 64:  # memory: longer ones are looked up each time
            if len(self) >= self.room:
                self.clear()
            self[word] = w
        return w


def segments(scores: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last + 1) of ``scores`` - ``drift``, in linear time.

    Only tokens above the drift can begin or end one; what lies between two of them is one step.
    Each candidate keeps the sums before its first and after its last token and merges to the left with
    the nearest candidate that starts lower, if that ends lower too.
    """
    up = np.flatnonzero(scores > drift)
    if not len(up):
        return []
    total = np.cumsum(scores - drift)
    held: list[list] = []  # first, last + 1, sum before, sum after, candidate to the left that starts lower
    for k in up.tolist():
        new = [k, k + 1, total[k] - (scores[k] - drift), total[k], -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                new[4] = j
                held.append(new)
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:]
    return [(float(r - l), a, b) for a, b, l, r, _ in held]


class Model:
    """Token weights, the drift, the extreme-value law of clean text and the calibration."""

    def __init__(self, weights: dict[str, float], drift: float) -> None:
        self.weights, self.drift, self.rate, self.log_k, self.coef = weights, drift, 1.0, 0.0, np.zeros(3)

    def scorer(self, room: int = 200_000):
        """A function from a text to the weights of its tokens, each occurrence's alike."""
        get = Weights(self.weights, room).__getitem__

        def scores(text: str) -> np.ndarray:
            words = tokens(text)
            return np.fromiter(map(get, words), np.float64, len(words))

        return scores

    def fit_law(self, values: np.ndarray, counts: np.ndarray, best: float, log_n: float) -> None:
        """rate: the root of E exp(rate * score) = 1 over the tokens of clean texts (``counts`` of each of
        ``values``); log_k: from the means of their best segments and of the logs of their lengths."""
        p, v = counts / max(1, counts.sum()), values - self.drift
        if not len(v) or v.max() <= 0:
            return
        low, high = 1e-6, 50.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * v, 700))).sum() < 1 else (low, mid)
        self.rate = low
        self.log_k = self.rate * best - log_n - EULER

    def features(self, x: np.ndarray) -> tuple[float, float, list]:
        """Of the best segment and of all significant ones together: minus the log of the number of such
        segments that clean text of this length would show."""
        base = self.log_k + np.log(max(1, len(x)))
        found = [(self.rate * s - base, a, b) for s, a, b in segments(x, self.drift)]
        best = max((e for e, _, _ in found), default=-base)
        kept = [f for f in found if f[0] > 0]
        return max(-20.0, min(60.0, best)), float(np.log1p(sum(e for e, _, _ in kept))), kept

    def probability(self, x: np.ndarray) -> tuple[float, list]:
        best, whole, kept = self.features(x)
        z = self.coef @ np.array([1.0, best, whole])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), kept

    def calibrate(self, features: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression on features of unit spread with a penalty on the slopes, which makes the loss
        strictly convex; Newton steps are halved until the loss falls.  No slope is negative."""
        scale = np.maximum(features.std(0), 1e-9)
        used = [1, 2]
        while True:
            cols = [0, *used]
            x = np.c_[np.ones(len(label)), features / scale][:, cols]
            cost = np.diag([1e-6, *[ridge] * len(used)])
            loss = lambda w: np.logaddexp(0, -(2 * label - 1) * (x @ w)).sum() + w @ cost @ w / 2  # noqa: E731, B023
            w = np.zeros(len(cols))
            now = loss(w)
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + cost, x.T @ (label - p) - cost @ w)
                size = 1.0
                while size > 1e-6 and loss(w + size * step) > now:
                    size /= 2
                w = w + size * step
                before, now = now, loss(w)
                if before - now < 1e-9 * max(1.0, now):
                    break
            if len(used) == 1 or (w[1:] >= 0).all():
                break
            used.remove(used[int(np.argmin(w[1:]))])
        self.coef = np.zeros(3)
        self.coef[cols] = w
        self.coef[1:] = np.maximum(self.coef[1:] / scale, 0)


class Folds:
    """Weights for each part of the sample, learned from the other parts."""

    def __init__(self, weights: list[dict[str, float]], drift: float, rate: float = 1.0, log_k: float = 0.0) -> None:
        self.weights, self.drift, self.rate, self.log_k = weights, drift, rate, log_k

    def models(self) -> list[tuple]:
        """(model, function from a text to its tokens' weights) of each part."""
        out = []
        for w in self.weights:
            m = Model(w, self.drift)
            m.rate, m.log_k = self.rate, self.log_k
            out.append((m, m.scorer(10_000)))  # one of many: little memory each
        return out


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, fold: int, sample_rows: int, table_size: int, drift: float, seed: int, parts: int = 10) -> Model:
    """Fitted on at most ``sample_rows`` labelled documents, chosen by a hash of the id; one of each equal text counts.

    The extreme-value law and the calibration see each text through weights that the other ``parts`` - 1 parts of the
    sample gave (cross-fitting); the driver gets the counts of distinct weights and two features of each text.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "toxicity")
    fold_of = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(fold_of != fold)
    marks = marks.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    marks = scratch.put(marks, "labels")
    sample = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(marks), "id")
    sample = scratch.put(sample.select("text", "y", F.sha2("text", 256).alias("same")).groupBy("same").agg(F.max("y").alias("y"), F.any_value("text").alias("text")).select("text", "y", F.pmod(F.xxhash64("same"), F.lit(parts)).cast("int").alias("part")), "sample")

    def count(batches):
        seen: defaultdict = defaultdict(Counter)

        def rows():
            for (part, toxic), own in seen.items():
                words = list(own)
                n, none = pa.array([own[x] for x in words], pa.int64()), pa.array([0] * len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([part] * len(words), pa.int32()), n if toxic else none, none if toxic else n], ["x", "part", "toxic", "clean"])
            seen.clear()

        for whole in batches:
            for b in sub_batches([whole], "text", 2 << 20):
                for text, y, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    found = set(tokens(text))
                    # The empty token stands for all documents.
                    seen[part, y > 0].update({""}.union(map(name, found), *map(stems, found)))
                    if sum(map(len, seen.values())) > 100_000:  # memory: counts are summed later anyway
                        yield from rows()
        yield from rows()
        give_back()

    each = [F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for p in range(parts) for c in ("toxic", "clean")]
    counts = sample.mapInArrow(count, "x string, part int, toxic long, clean long").groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *each)
    counts = scratch.put(counts, "counts")
    docs = counts.where("x = ''").first() or dict.fromkeys(counts.columns, 0)
    # The table: tokens of three documents at least, those that lean most to one side first.
    lean = F.abs(F.col("toxic") / F.lit(float(docs["toxic"] or 1)) - F.col("clean") / F.lit(float(docs["clean"] or 1))) / F.sqrt(F.col("toxic") + F.col("clean"))
    top = counts.where("x <> '' and toxic + clean >= 3").orderBy(F.desc(lean), "x").limit(table_size).collect()
    n = {c: np.array([r[c] for r in top], float) for c in counts.columns[1:]}

    def weights(without: int | None = None) -> dict[str, float]:
        t, c, all_t, all_c = n["toxic"], n["clean"], docs["toxic"], docs["clean"]
        if without is not None:
            t, c, all_t, all_c = t - n[f"toxic{without}"], c - n[f"clean{without}"], all_t - docs[f"toxic{without}"], all_c - docs[f"clean{without}"]
        d = np.where(t + c >= 3, log_odds(t, c, all_t, all_c), 0.0)
        return {r.x: float(v) for r, v in zip(top, d, strict=True) if v}

    model = Model(weights(), drift)
    others = Folds([weights(p) for p in range(parts)], drift)
    sent = Shared(spark, others)

    def law(batches):
        """(kind, x, n): how often tokens of clean texts have weight x (``v``), and the sums of their best segments, of
        the logs of their lengths and of their number."""
        models, found = sent.value.models(), defaultdict(float)
        for whole in batches:
            for b in sub_batches([whole], "text"):
                for text, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = models[part][1](text)
                    if not len(x):
                        continue
                    for v, k in zip(*np.unique(x, return_counts=True), strict=True):
                        found["v", float(v)] += k
                    found["best", 0.0] += max((s for s, _, _ in segments(x, drift)), default=0.0)
                    found["log", 0.0] += float(np.log(len(x)))
                    found["texts", 0.0] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.float64()), pa.array([float(found[k]) for k in keys], pa.float64())], ["kind", "x", "n"])

    clean = sample.where("y <= 0").select("text", "part")
    sums = clean.mapInArrow(law, "kind string, x double, n double").groupBy("kind", "x").agg(F.sum("n").alias("n")).orderBy("kind", "x").collect()
    got = {r.kind: r.n for r in sums if r.kind != "v"}
    own = [r for r in sums if r.kind == "v"]
    texts = got.get("texts", 0) or 1
    model.fit_law(np.array([r.x for r in own], float), np.array([r.n for r in own], float), got.get("best", 0.0) / texts, got.get("log", 0.0) / texts)
    others.rate, others.log_k = model.rate, model.log_k
    fitted = Shared(spark, others)

    def features(batches):
        models = fitted.value.models()
        for whole in batches:
            for b in sub_batches([whole], "text"):
                rows = [models[p][0].features(models[p][1](t))[:2] for t, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.float64()), pa.array([x for _, x in rows], pa.float64()), b.column(1)], ["best", "whole", "y"])
        give_back()

    rows = sample.mapInArrow(features, "best double, whole double, y int").toArrow()
    best, whole, label = rows["best"].to_numpy(), rows["whole"].to_numpy(), rows["y"].to_numpy() > 0
    if 0 < label.sum() < len(label):
        order = np.lexsort((whole, best, label))  # sums don't depend on the order in which tasks ended
        model.calibrate(np.stack([best, whole], 1)[order], label[order].astype(np.float64))
    else:
        model.coef = np.array([-3.0 if not label.any() else 3.0, 0.0, 0.0])
    return model


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = 0.7, sample_rows: int = 20_000, table_size: int = 20_000, drift: float = 0.2, seed: int = 42, with_passages: bool = False
) -> DataFrame:
    """Probability that ``label_col`` marks a text as toxic.

    Tokens score their log-odds (Dirichlet prior) less ``drift``.  A linear-time scan finds every maximal
    scoring segment of a whole text; by the extreme-value law of clean text a segment's score becomes an
    expected count, and the best segment with the sum over all significant ones is calibrated
    to a probability.  Labels are learned from rows of ``labels`` whose crc32(id as text) mod ``folds`` is not
    ``fold``, on at most ``sample_rows`` documents and ``table_size`` tokens; all rows of ``df`` are scored, from
    their text alone.

    Returns ``id_col``, held_out, score, predicted (1 if score >= ``threshold``) and, with ``with_passages``, passages
    (first token, last + 1, log of significance).  Null and empty texts are scored as texts without tokens;
    a null id counts as the empty text in the crc; without labels of both kinds the score is constant.
    Rows may repeat (labels of one id: the highest counts); other columns are not carried; no rows give no rows.
    """
    model = Shared(df.sparkSession, train(df, labels, id_col, text_col, label_col, folds, fold, sample_rows, table_size, drift, seed))

    def run(batches):
        known = model.value
        scores = known.scorer()
        for whole in batches:
            for b in sub_batches([whole], "text", 4 << 20):
                found = [known.probability(scores(t or "")) for t in b.column(2).to_pylist()]
                out = [b.column(0), b.column(1), pa.array([p for p, _ in found], pa.float64())]
                if with_passages:
                    out.append(pa.array([[{"first": x, "last": y, "strength": e} for e, x, y in k] for _, k in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("strength", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(out, ["id", "held_out", "score", "passages"][: len(out)])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    fold_of = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    out = df.select(F.col(id_col).alias("id"), (fold_of == fold).alias("held_out"), F.col(text_col).alias("text"))
    out = out.mapInArrow(run, f"id {kind}, held_out boolean, score double" + ", passages array<struct<first:int,last:int,strength:double>>" * with_passages)
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *(["passages"] if with_passages else []))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, threshold: float = 0.7, sample_rows: int = 20_000, table_size: int = 20_000, drift: float = 0.2, seed: int = 42) -> DataFrame:
    """The rows of ``df``, all columns, whose score in ``toxicity`` is below ``threshold``; nothing is shuffled."""
    model = Shared(df.sparkSession, train(df, labels, id_col, text_col, label_col, folds, fold, sample_rows, table_size, drift, seed))

    def run(batches):
        known = model.value
        scores = known.scorer()
        for whole in batches:
            for b in sub_batches([whole], text_col, 4 << 20):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([known.probability(scores(t or ""))[0] < threshold for t in texts]))
        give_back()

    return df.mapInArrow(run, df.schema)
