"""Language identification (operator 6): script ranges, then Viterbi over per-word scores."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, Shared, small, sub_batches
from roadpulse.llm.tokens import worker_store

WORD = re.compile(r"[^\W\d_]+")

#: First code point, last code point, script.
#: Fixed values.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"),
]
STARTS = [x[0] for x in SCRIPTS]

#: Letters of a unit at most; scripts without spaces between words have short units.
LONGEST, SPACELESS = 40, {"Han": 1, "Kana": 3, "Thai": 3, "Lao": 3, "Myanmar": 3, "Khmer": 3}
#: Texts that may hold more than words of one script, and the units of a word: letters of one script.
MANY = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\U0010ffff]")
CLASSES = {name: "".join(f"{chr(a)}-{chr(b)}" for a, b, x in SCRIPTS if x == name) for name in dict.fromkeys(x[2] for x in SCRIPTS)}
UNIT = re.compile("|".join([*(f"[{c}]{{1,{SPACELESS.get(name, LONGEST)}}}" for name, c in CLASSES.items()), f"[^{''.join(CLASSES.values())}]{{1,{LONGEST}}}"]))


def script(word: str) -> str:
    c = ord(word[0])
    k = bisect_right(STARTS, c) - 1
    return SCRIPTS[k][2] if k >= 0 and c <= SCRIPTS[k][1] else "other"


def units(text: str) -> list[str]:
    """What is scored: the words of a text in lower case, cut where the script changes, after ``LONGEST`` letters, and
    in scripts without spaces after one letter (Han) or three, so that every letter counts."""
    text = text.lower()
    words = WORD.findall(text)
    if not text.isascii() and MANY.search(text):
        return [u for w in words for u in UNIT.findall(w)]
    if words and max(map(len, words)) > LONGEST:
        return [u for w in words for u in ([w] if len(w) <= LONGEST else UNIT.findall(w))]
    return words


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


#: Languages, and cells (words or trigrams times languages) of the model's tables, at most.
MOST_LANGS, MOST_CELLS = 10_000, 1 << 24


class Model:
    """Log-probabilities of words and letter trigrams for each language, and the scripts it is written in."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], trigrams: dict[str, np.ndarray], scripts: dict[str, np.ndarray], worst: float = 8.0) -> None:
        self.langs, self.worst, n = langs, worst, len(langs)
        self.words, self.trigrams = ({x: k for k, x in enumerate(t)} for t in (words, trigrams))
        self.word_logs, self.trigram_logs = self._logs(words, 0.1, n), self._logs(trigrams, 0.5, n)
        total = np.sum(list(scripts.values()), axis=0) if scripts else np.ones(n)
        names = list(scripts)
        #: Which languages are written in a script; the last row is for scripts that none is.
        self.scripts = {x: k for k, x in enumerate(names)}
        self.able = np.array([*(np.array(scripts[x]) > 0.01 * np.maximum(total, 1) for x in names), np.zeros(n, bool)]).reshape(len(names) + 1, n)

    @staticmethod
    def _logs(counts: dict[str, np.ndarray], prior: float, n: int) -> np.ndarray:
        """Logs of the shares, with a last row of zeros for what is unknown."""
        m = np.array(list(counts.values()), np.float64).reshape(len(counts), n)
        m = np.log(m + prior) - np.log(m.sum(0) + prior * max(1, len(m)))
        return np.concatenate([m, np.zeros((1, n))]).astype(np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """0 for a word's likeliest language, below that for the others, -``worst`` at least and for languages not
        written in its script; all 0 if no language is."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        get, none = self.words.get, len(self.words)
        at = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        s = self.word_logs[at]
        rare = np.flatnonzero(at == none)
        if len(rare):
            parts = [grams(words[k]) for k in rare.tolist()]
            get, none = self.trigrams.get, len(self.trigrams)
            flat = np.fromiter((get(g, none) for p in parts for g in p), np.int64)
            s[rare] = np.add.reduceat(self.trigram_logs[flat], np.cumsum([0, *map(len, parts)])[:-1], axis=0)
        first = {c: self.scripts.get(script(c), len(self.scripts)) for c in {w[0] for w in words}}
        able = self.able[[first[w[0]] for w in words]]
        s = np.where(able, s, -np.inf)
        top = s.max(1, keepdims=True)
        return np.where(np.isfinite(top), np.maximum(s - np.where(np.isfinite(top), top, 0), -self.worst), 0).astype(np.float32)


class Scores(dict):
    """Word -> row of ``table``; starts anew when the table is full."""

    def __init__(self, model: Model, room: int = 300_000) -> None:
        super().__init__()
        self.model, self.table = model, np.zeros((min(room, MOST_CELLS // len(model.langs)), len(model.langs)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > len(self.table):
            self.clear()
            new = list(set(words))
            if len(new) > len(self.table):
                return np.concatenate([self.rows(words[: len(words) // 2]), self.rows(words[len(words) // 2 :])])
        at = len(self)
        self.table[at : at + len(new)] = self.model.score(new)
        self.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def viterbi(s: np.ndarray, start: np.ndarray, size: np.ndarray, penalty: float) -> list[np.ndarray]:
    """For texts whose word scores lie in ``s`` (text k: size[k] rows from start[k] on) the likeliest sequences of
    languages, each switch costing ``penalty``.  All texts take a step at a time, the longest ones last."""
    order = np.argsort(-size, kind="stable")
    begin, n = start[order], size[order]
    if not len(order):
        return []
    v, own = s[begin].astype(np.float64), np.arange(s.shape[1], dtype=np.int16)
    came = []
    alive = len(order)
    ends = np.zeros(len(order), np.int64)
    for t in range(1, int(n[0]) + 1):
        now = int(np.searchsorted(-n, -t, side="left"))  # texts with more than t words
        if now < alive:
            ends[now:alive] = v[now:alive].argmax(1)
            alive = now
            if not alive:
                break
        v = v[:alive]
        best = v.argmax(1)
        top = v[np.arange(alive), best][:, None] - penalty
        stay = v >= top
        came.append(np.where(stay, own, best.astype(np.int16)[:, None]))
        v = np.where(stay, v, top) + s[begin[:alive] + t]
    at, labels = ends, np.zeros((len(s) + 1,), np.int32)
    for t in range(int(n[0]) - 1, -1, -1):
        if t < len(came):  # from word t + 1 back to word t
            k = len(came[t])
            at[:k] = came[t][np.arange(k), at[:k]]
        live = int(np.searchsorted(-n, -t, side="left"))
        labels[begin[:live] + t] = at[:live]
    return [labels[a : a + k] for a, k in zip(start.tolist(), size.tolist(), strict=True)]


def one_language(s: np.ndarray, start: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose word scores follow each other (text k from row start[k] on): sums of scores, the best
    language, and whether no switch can pay: no other language gains more than ``penalty`` on any stretch, so
    leaving the best one can't pay, and the others together gain no more, so doing without it can't."""
    total = np.add.reduceat(s, start, axis=0, dtype=np.float64)
    best = total.argmax(1)
    size = np.diff(np.r_[start, len(s)])
    text = np.repeat(np.arange(len(start)), size)
    gain = s - s[np.arange(len(s)), best[text]][:, None]
    others = np.where(np.arange(s.shape[1])[None, :] == best[text][:, None], -np.inf, gain).max(1)
    most = np.add.reduceat(others, start, dtype=np.float64)
    for k in range(s.shape[1]):
        c = np.cumsum(gain[:, k], dtype=np.float64)
        before = c - gain[:, k]
        # A large step down between texts keeps the running minimum inside each.
        fall = text * (2.0 * (np.abs(c).max() + 1))
        low = np.minimum.accumulate(before - fall) + fall
        most = np.maximum(most, np.maximum.reduceat(c - low, start))
    return total, best, most <= penalty - 1e-3


def train(df: DataFrame, rows, text_col: str, lang_col: str, id_col: str, per_lang: int, table_size: int, seed: int) -> Model:
    """Fitted on about ``per_lang`` documents of each language, chosen by a hash of the id.  Over ``MOST_LANGS``
    languages raise ValueError; with many the table has fewer rows, so that its cells stay below ``MOST_CELLS``."""
    base = df.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in base.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect()}
    langs = list(n)
    if not langs:
        return Model([], {}, {}, {})
    if len(langs) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    table_size = min(table_size, MOST_CELLS // len(langs))
    scale = 1 << 24
    limit = small(df.sparkSession, [(x, int(scale * min(1.0, per_lang / n[x])), k) for k, x in enumerate(langs)], "l string, most long, k int")
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(scale))
    sample = base.join(F.broadcast(limit), F.col(lang_col).cast("string") == F.col("l")).where(draw < F.col("most")).select(F.col(text_col).alias("text"), "k")

    def count(batches):
        seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for whole in batches:
            for b in sub_batches([whole], "text"):
                for text, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen["w", k].update(units(text))
        for (_, k), words in list(seen.items()):
            for word, c in words.items():
                for g in grams(word):
                    seen["g", k][g] += c
                seen["s", k][script(word)] += c * len(word)
        for (kind, k), found in seen.items():
            items = list(found.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), pa.array([x for x, _ in part], pa.string()), pa.array([k] * len(part), pa.int32()), pa.array([c for _, c in part], pa.int64())], ["kind", "x", "k", "n"])

    each = sample.mapInArrow(count, "kind string, x string, k int, n long").groupBy("kind", "x", "k").agg(F.sum("n").alias("n"))
    # One cell for each language at most.
    table = each.groupBy("kind", "x").agg(F.sum("n").alias("n"), F.collect_list(F.struct("k", "n")).alias("cells"))
    table = Scratch(df.sparkSession, "language").put(table, "counts")
    found: dict[str, dict[str, np.ndarray]] = {}
    for kind in "wgs":
        found[kind] = {}
        for r in table.where(F.col("kind") == kind).where("n > 1").orderBy(F.desc("n"), "x").limit(table_size).collect():
            found[kind][r.x] = np.zeros(len(langs), np.int64)
            for k, c in r.cells:
                found[kind][r.x][k] = c
    return Model(langs, found["w"], found["g"], found["s"])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, penalty: float = 12.0, per_lang: int = 4000, table_size: int = 30_000, seed: int = 42, with_spans: bool = False) -> DataFrame:
    """The language of every whole text, from its words alone.

    The words' scripts leave candidate languages; a word (``units``: every letter of the text is in one) scores each by
    how often it, or else its letter trigrams, occurred in that language; Viterbi with ``penalty`` for a switch labels the words, so mixed
    texts fall into spans (``with_spans``: array of first unit, last unit + 1, language).  Texts in
    which no switch can pay are told by sums, with the same result.

    Learns from text and non-null ``lang_col`` of documents whose crc32(id as text) mod ``folds`` is not ``fold``,
    on a bounded sample: about ``per_lang`` documents of a language, ``table_size`` words and trigrams.  All rows are
    predicted.  Returns ``id_col``, held_out, lang_pred (of most words; ``und`` if the text is null or has no letter,
    or nothing was learned), score (0 to 1: share of words times posterior).  A null id counts as the
    empty text in the crc.  Rows may repeat; other columns are not carried; no rows give no rows.
    """
    fold_of = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    model = Shared(df.sparkSession, train(df, fold_of != fold, text_col, lang_col, id_col, per_lang, table_size, seed))

    token = uuid.uuid4().hex

    def run(batches):
        known, store = model.value, worker_store()
        langs = known.langs
        if store.get("language", (None,))[0] != token:  # the worker's scores of this model outlive a task
            store["language"] = token, Scores(known) if langs else None
        cache = store["language"][1]
        for whole in batches:
            for b in sub_batches([whole], "text", 4 << 20):
                n = b.num_rows
                words = [units(t) if t else [] for t in b.column(2).to_pylist()]
                able = [k for k, w in enumerate(words) if w and cache is not None and any(map(str.isalpha, w))]
                pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
                if able:
                    start = np.cumsum([0, *(len(words[k]) for k in able)])[:-1]
                    s = cache.rows([w for k in able for w in words[k]])
                    total, best, plain = one_language(s, start, penalty)
                    end = np.r_[start[1:], len(s)]
                    odds = np.exp(total - total.max(1, keepdims=True))
                    odds /= odds.sum(1, keepdims=True)
                    mixed = np.flatnonzero(~plain)
                    paths = dict(zip(mixed.tolist(), viterbi(s, start[mixed], (end - start)[mixed], penalty), strict=True))
                    for j, k in enumerate(able):
                        a, share = int(best[j]), 1.0
                        if not plain[j]:
                            path = paths[j]
                            count = np.bincount(path, minlength=len(langs))
                            a = int(count.argmax())
                            share = float(count[a] / len(path))
                        sure = float(odds[j, a]) if plain[j] else 1.0
                        pred[k], score[k] = langs[a], share * sure
                        if with_spans:
                            cut = [0, len(words[k])] if plain[j] else [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                            spans[k] = [{"first": x, "last": y, "lang": langs[a if plain[j] else int(path[x])]} for x, y in zip(cut, cut[1:], strict=False)]
                out = [b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if with_spans:
                    out.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["id", "held_out", "lang_pred", "score", "spans"][: len(out)])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), (fold_of == fold).alias("held_out"), F.col(text_col).alias("text"))
    out = out.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<first:int,last:int,lang:string>>" * with_spans)
    return out.withColumnRenamed("id", id_col)
