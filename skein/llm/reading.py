"""How demanding each document is to read.

Every sentence gets a distribution over five reading levels from two regularised
multinomial models, one on the characters of its words and one on the words
themselves; both are fitted to raters' levels of a bounded sample of documents. A
document's difficulty is the mean level over its sentences, weighted by their words,
calibrated to raters' levels, of which 4 and 5 stand for college reading. A grade formula
(Flesch-Kincaid, over sentences as a reader counts them) can be reported beside it and
decides nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.visual import look
from skein.session import ship

LEVELS = 5
BUCKETS = 1 << 13
#: Labelled documents used for fitting, at most; chosen by hash, so the same on every run.
TRAIN_DOCS = 800
L2, STEPS = 1e-4, 120
#: Calibrated level from which on a document asks for college reading: nearer to 4 than to 3. Words it must have.
COLLEGE, LEAST_WORDS = 3.5, 60

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = set(
    "mr mrs ms dr prof st jr sr vs etc e.g i.e cf al approx no nos vol vols pt ch sec art reg regs para paras fig ed eds dept est inc ltd co corp u.s u.k a.m p.m jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "ave rd blvd ext tel gen gov rev capt lt sgt col pp p ca viz ibid op cit".split()
)
#: Frequent words that tell English.
ENGLISH = set("the of and to in a is that for it on with as at by this be are from or an was not have has you your i we they my our may shall must will can if when which any its their been so no after before because us me he she one all while".split())
LINK = re.compile(r"(?:https?://|www\.)\S+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
BULLET = re.compile(r"^\s*(?:[-*•–‣◦>#]+|\(?\d{1,3}[.)]|[a-z]\))\s+")
END = re.compile(r"([.!?…]+)([\"'”’)\]]*)(\s+|$)")


@lru_cache(maxsize=100_000)
def syllables(word: str) -> int:
    w = word.lower()
    if not w.isalpha():
        return sum(map(syllables, re.findall(r"[^\W\d_]+", w))) or 1
    n = len(re.findall(r"[aeiouyàâäéèêëïîôöùûü]+", w))
    if w.endswith("e") and not w.endswith(("le", "ee", "ye")) and n > 1:
        n -= 1
    if w.endswith("ed") and not w.endswith(("ted", "ded")) and n > 1:
        n -= 1
    if w.endswith("es") and not w.endswith(("ses", "zes", "ches", "shes", "xes", "ges", "ces")) and n > 1:
        n -= 1
    n += len(re.findall(r"i[ao](?!u)|eo|ua(?!r)|[^q]uou|io(?=[^n])", w)) if n > 2 else 0
    return max(n, 1)


def _blocks(text: str) -> list[str]:
    """Stretches of text that no sentence crosses: paragraphs, list lines, unwrapped lines."""
    blocks: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        lines = [x for x in paragraph.split("\n") if x.strip()]
        longest = max((len(x) for x in lines), default=0)
        wrapped = len(lines) > 2 and longest <= 110 and sum(len(x) > 0.6 * longest for x in lines[:-1]) >= 0.8 * (len(lines) - 1)
        open_line = False
        for line in lines:
            bullet = BULLET.match(line)
            body = BULLET.sub("", line).strip()
            if not body:
                open_line = False
                continue
            runs_on = open_line and not (bullet and not line.lstrip().startswith(">")) and (body[0].islower() or body[0] in ",;)" or wrapped or body[0].isdigit())
            if runs_on:
                blocks[-1] += " " + body
            else:
                blocks.append(body)
            open_line = body[-1] not in ".!?…:"
    return blocks


def prose(text: str) -> str:
    """The text without markup, character codes and links."""
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = TAG.sub(" ", text)
    text = LINK.sub(" ", text)
    return text if text.isascii() else "\n".join(map(look, text.split("\n")))


def sentences(text: str) -> list[list[str]]:
    """Words by sentence, as a reader would count sentences."""
    out = []
    for block in _blocks(prose(text)):
        small = block.lower() == block
        start = 0
        for m in END.finditer(block):
            last = re.search(r"(\S+)$", block[start : m.start()])
            token = last.group(1).lower().strip("\"'“‘([") if last else ""
            rest = block[m.end() :]
            if m.group(1) == "." and rest:
                abbreviated = token in ABBREVIATIONS or re.fullmatch(r"(?:[a-z]\.)*[a-z]", token) and token not in ("i", "a")
                if abbreviated and not (token in ("etc", "a.m", "p.m", "inc", "ltd", "co") and rest[0].isupper()):
                    continue
                if not small and rest[0].islower():
                    continue
            ws = WORD.findall(block[start : m.end()])
            if ws:
                out.append(ws)
                start = m.end()
        ws = WORD.findall(block[start:])
        if ws:
            out.append(ws)
    return out


def grade(sents: list[list[str]]) -> float:
    """US school grade by Flesch and Kincaid; 0 for no words."""
    n = sum(map(len, sents))
    if not n:
        return 0.0
    return 0.39 * n / len(sents) + 11.8 * sum(syllables(w) for s in sents for w in s) / n - 15.59


def is_english(sents: list[list[str]]) -> bool:
    ws = [w.lower() for s in sents for w in s]
    return bool(ws) and sum(w in ENGLISH for w in ws) >= 0.15 * len(ws) and sum(w.isascii() for w in ws) >= 0.8 * len(ws)


# -- models --------------------------------------------------------------------------


def plain_form(word: str) -> str:
    """Lower case; of words with digits only their shape, as codes and amounts are not read as words."""
    if word.isalpha():
        return word.lower()
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", word)) if any(c.isdigit() for c in word) else word.lower()


@lru_cache(maxsize=200_000)
def _char_features(word: str) -> tuple[int, ...]:
    w = f"^{plain_form(word)}$"
    return tuple(zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2))


@lru_cache(maxsize=200_000)
def _word_feature(word: str) -> int:
    return zlib.crc32(plain_form(word).encode()) % (BUCKETS - 64) + 64


def char_features(words: list[str]) -> list[int]:
    return [f for w in words for f in _char_features(w)]


def _shape(words: list[str]) -> tuple[int, int]:
    """Classes of a sentence's length and of its words' mean length."""
    return min(len(words) // 2, 31), 32 + min(int(2 * sum(map(len, words)) / len(words)), 31)


def word_features(words: list[str]) -> list[int]:
    return [*_shape(words), *map(_word_feature, words)]


class Model(NamedTuple):
    chars: np.ndarray
    words: np.ndarray
    levels: tuple[float, float]


def fit(rows: list[list[int]], target: np.ndarray, l2: float = L2, steps: int = STEPS) -> np.ndarray:
    """Weights (features + bias, levels) of a multinomial model with a squared penalty.

    rows: features by sentence, each of equal weight within its sentence; target: (n, levels).
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((f for r in rows for f in r), np.int64, int(lengths.sum()))
    pairs, times = np.unique(np.repeat(np.arange(len(rows)), lengths) * BUCKETS + flat, return_counts=True)
    row, index = np.divmod(pairs, BUCKETS)
    starts = np.searchsorted(row, np.arange(len(rows)))
    value = times / np.sqrt(lengths)[row]
    w = np.zeros((BUCKETS + 1, LEVELS))
    speed = np.full_like(w, 1e-8)
    for _ in range(steps):
        z = np.add.reduceat(w[index] * value[:, None], starts, axis=0) + w[-1]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        r = (p - target) / len(rows)
        g = l2 * w
        for k in range(LEVELS):
            g[:BUCKETS, k] += np.bincount(index, weights=r[row, k] * value, minlength=BUCKETS)
        g[-1] = r.sum(axis=0)
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    return w.astype(np.float32)


class Scorer:
    """A model applied document by document; what a word adds to the scores is worked out once."""

    def __init__(self, model: Model, words: int = 100_000):
        self.model = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((words, 2 * LEVELS + 1))

    def _place(self, word: str) -> int:
        """The word's row: sums over its character features, their number, its word feature."""
        form = plain_form(word)
        k = self.at.get(form)
        if k is None:
            if len(self.at) >= len(self.rows):
                return -1
            k = self.at[form] = len(self.at)
            f = list(_char_features(form))
            self.rows[k] = np.concatenate([self.model.chars[f].sum(axis=0), [len(f)], self.model.words[_word_feature(form)]])
        return k

    def sentences(self, sents: list[list[str]]) -> np.ndarray:
        """(sentences, levels): the mean of both models' distributions."""
        lengths = np.array([len(s) for s in sents])
        at = [self._place(w) for s in sents for w in s]
        if -1 in at:  # the table is full of words from other documents
            self.at.clear()
            at = [self._place(w) for s in sents for w in s]
            if -1 in at:
                self.rows = np.zeros((2 * len(self.rows), self.rows.shape[1]))
                self.at.clear()
                return self.sentences(sents)
        x = np.add.reduceat(self.rows[at], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
        shape = np.array([_shape(s) for s in sents])
        c = x[:, :LEVELS] / np.sqrt(x[:, LEVELS : LEVELS + 1]) + self.model.chars[-1]
        w = (x[:, LEVELS + 1 :] + self.model.words[shape].sum(axis=1)) / np.sqrt(lengths + 2)[:, None] + self.model.words[-1]
        z = np.stack([c, w])
        z = np.exp(z - z.max(axis=2, keepdims=True))
        return (z / z.sum(axis=2, keepdims=True)).mean(axis=0)

    def document(self, sents: list[list[str]]) -> np.ndarray:
        """The mean over sentences, weighted by words."""
        if not sents:
            return np.full(LEVELS, np.nan)
        return np.average(self.sentences(sents), axis=0, weights=[len(s) for s in sents])


def train(texts: list[str], levels: list[float]) -> Model:
    """Models from documents and their mean rated level."""
    rows_c, rows_w, target, docs = [], [], [], []
    for t, v in zip(texts, levels, strict=True):
        ss = sentences(t)
        if not ss:
            continue
        docs.append((ss, v))
        soft = np.zeros(LEVELS)
        low = int(np.clip(np.floor(v), 1, LEVELS))
        soft[low - 1] += 1 - (v - low)
        soft[min(low, LEVELS - 1)] += v - low
        for s in ss:
            rows_c.append(char_features(s))
            rows_w.append(word_features(s))
            target.append(soft)
    if not docs:
        raise ValueError("no labelled document to learn from")
    y = np.array(target)
    model = Model(fit(rows_c, y), fit(rows_w, y), (0.0, 1.0))
    scorer = Scorer(model)
    mean = np.array([scorer.document(s) @ np.arange(1, LEVELS + 1) for s, _ in docs])
    a = np.stack([np.ones_like(mean), mean], axis=1)
    rated = np.array([v for _, v in docs])
    return model._replace(levels=tuple(map(float, np.linalg.lstsq(a.T @ a + 1e-6 * np.eye(2), a.T @ rated, rcond=None)[0])))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, seed: int = 42) -> tuple[list[str], list[float]]:
    """At most `limit` labelled English documents, the same ones on every run; unusable labels are ignored."""
    mean = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    some = mean.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy("doc_id").collect()
    rows = [r for r in rows if r["text"] and is_english(sentences(r["text"]))]
    return [r["text"] for r in rows], [r["level"] for r in rows]


def reading_levels(docs: DataFrame, model: Model | None, formula: bool = True) -> DataFrame:
    """(doc_id, n_words, n_sentences, english, level, formula_grade, p1 ... p5), one row per row of docs.

    n_words counts between spaces, level comes from the models, p1 ... p5 are the document's
    distribution over levels; formula_grade is null unless asked for. Null and wordless
    texts have 0 words, english false and null estimates, as have all texts without a model. One pass without a shuffle; the
    models are the only thing sent along.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        scorer = Scorer(m) if m else None
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                ss = sentences(t) if t else []
                if not ss:
                    out.append((d, len(t.split()) if t else 0, 0, False, *[None] * (2 + LEVELS)))
                    continue
                if scorer is None:
                    out.append((d, len(t.split()), len(ss), is_english(ss), None, grade(ss) if formula else None, *[None] * LEVELS))
                    continue
                p = scorer.document(ss)
                level = float(np.clip(m.levels[0] + m.levels[1] * float(p @ np.arange(1, LEVELS + 1)), 1, LEVELS))
                out.append((d, len(t.split()), len(ss), is_english(ss), level, grade(ss) if formula else None, *map(float, p)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_sentences", "english", "level", "formula_grade", *(f"p{k}" for k in range(1, LEVELS + 1))])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_words int, n_sentences int, english boolean, level double, formula_grade double, " + ", ".join(f"p{k} double" for k in range(1, LEVELS + 1)))
