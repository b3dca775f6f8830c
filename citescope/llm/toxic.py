"""Toxicity: a learned lexicon as a trie, searched with Levenshtein automata; quoted hits count apart."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled rows a model is fitted on at most, chosen by the hash of their doc_id.
MAX_LABELLED = 12_000
#: Marks that open and close a quotation, and words that report what somebody else said.
OPENING, CLOSING = "\"'“„«‹‘", "\"'”“»›’"
REPORTING = ("said", "says", "wrote", "quoted", "called", "reported", "sagte", "schrieb", "dijo", "escribió", "dit", "écrit")
_EDGE = " .,!?;:()[]{}<>*#$%&|…—–-" + OPENING + CLOSING
_STEM_FROM, _STEM_TO = 4, 12
_REMEMBERED = 1 << 18
FEATURES = ("hits", "near_hits", "quoted_hits", "log_words")


def normal(word: str) -> str:
    return word.lower().strip(_EDGE)


def _by_length(parts: Iterable[str]) -> list[tuple[int, set[str]]]:
    out: dict[int, set[str]] = {}
    for part in parts:
        out.setdefault(len(part), set()).add(part)
    return sorted(out.items())


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    stem: bool = False


class Lexicon:
    """Terms (whole words or stems) in a trie.

    `find` walks the trie and a Levenshtein automaton of the word together: a state is the row of edit distances
    between the trie path and all prefixes of the word; branches whose row holds nothing within the bound are cut.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = sorted(set(terms))
        self.root = Node()
        for term, stem in self.terms:
            node = self.root
            for c in term:
                node = node.children.setdefault(c, Node())
            node.term, node.stem = term, node.stem or stem
        # One edit leaves the first or the last half of a term as it is.
        fuzzy = [t for t, stem in self.terms if not stem and self.bound(len(t))]
        self.heads = _by_length(t[: len(t) // 2] for t in fuzzy)
        self.tails = _by_length(t[len(t) // 2 :] for t in fuzzy)
        self.known: dict[str, int] = {}

    @staticmethod
    def bound(length: int) -> int:
        """Edits allowed for a term of that length."""
        return 0 if length < 5 else 1

    def find(self, word: str) -> int | None:
        """Smallest distance of `word` to a term within that term's bound; 0 also for words that begin with a stem."""
        node, exact = self.root, None
        for c in word:
            node = node.children.get(c)
            if node is None:
                break
            if node.stem:
                return 0
            exact = node
        if node is not None and exact is not None and node.term is not None:
            return 0
        if not any(word[:k] in own for k, own in self.heads) and not any(word[-k:] in own for k, own in self.tails):
            return None
        best = None
        stack = [(child, c, list(range(len(word) + 1)), 1) for c, child in self.root.children.items()]
        while stack:
            node, c, above, depth = stack.pop()
            row = [depth]
            for i, x in enumerate(word):
                row.append(min(above[i] + (x != c), above[i + 1] + 1, row[i] + 1))
            if node.term is not None and not node.stem and row[-1] <= self.bound(len(node.term)):
                best = row[-1] if best is None else min(best, row[-1])
            if min(row) <= 1:
                stack += [(child, d, row, depth + 1) for d, child in node.children.items()]
        return best

    def distance(self, raw: str) -> int:
        """-1 for none. Remembers a bounded number of words."""
        value = self.known.get(raw)
        if value is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            found = self.find(normal(raw))
            value = self.known[raw] = -1 if found is None else found
        return value


def quoted(tokens: list[str], at: int, span: int = 6) -> bool:
    """The token stands inside quotation marks that open and close within `span` words, or shortly after a report."""
    left, right = tokens[max(0, at - span) : at + 1], tokens[at : at + span + 1]
    opened = next((k for k in range(len(left) - 1, -1, -1) if left[k][0] in OPENING), None)
    if opened is not None and not any(t[-1] in CLOSING for t in left[opened:-1]) and any(t.rstrip(".,!?;:")[-1:] in CLOSING and t.rstrip(".,!?;:") for t in right):
        return True
    return any(normal(t) in REPORTING for t in left[-4:-1])


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Plain hits, near hits (misspelled), quoted hits of either kind, log of the number of words."""
    tokens = (text or "").split()
    get, distance = lexicon.known.get, lexicon.distance
    found = [(i, d) for i, t in enumerate(tokens) if (d := get(t)) is None and (d := distance(t)) >= 0 or d >= 0]
    plain = near = apart = 0
    for i, d in found:
        if quoted(tokens, i):
            apart += 1
        elif d:
            near += 1
        else:
            plain += 1
    return [math.log1p(plain), math.log1p(near), math.log1p(apart), math.log1p(len(tokens)) / 10]


def _training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most `max_labelled` labelled rows outside the held-out fifth, as (doc_id, text, toxic)."""
    id_ = F.col("doc_id").cast("long")
    usable = labels.where("toxic in (0, 1) and doc_id is not null").select(id_.alias("doc_id"), F.col("toxic").cast("int"))
    outside = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = outside.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select(id_.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn_lexicon(training: DataFrame, precision: float = 0.95) -> list[tuple[str, bool]]:
    """(term, is a stem): words and word beginnings that mark label 1 beyond chance.

    Evidence is the number of different (word, word before) pairs, so a text that was copied many times counts once.
    A term must be so pure and frequent that chance would not produce one among all candidates.
    """

    def pairs(batch) -> Iterator[dict]:
        out = set()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before = ""
            for token in (text or "").split():
                word = normal(token)[:64]
                if len(word) >= _STEM_FROM:
                    out.add((word, before, toxic))
                before = word
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield dict(zip(("word", "before", "toxic"), columns, strict=True))

    seen = map_rows(training.select("text", "toxic"), pairs, "word string, before string, toxic int").distinct()
    total = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return []
    sizes = F.sequence(F.lit(_STEM_FROM), F.least(F.length("word"), F.lit(_STEM_TO)))
    stems = seen.select("toxic", F.explode(F.transform(sizes, lambda k: F.struct(F.substring("word", F.lit(1), k).alias("term"), F.lit(True).alias("stem")))).alias("t"))
    whole = seen.select("toxic", F.struct(F.col("word").alias("term"), F.lit(False).alias("stem")).alias("t"))
    counts = stems.unionByName(whole).groupBy("t").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    base = total[1] / (total[0] + total[1])
    least = math.ceil((math.log(total[1]) + 3) / -math.log(base)) if base < 0.9 else total[1]
    rows = counts.where((F.col("bad") >= least) & (F.col("bad") >= precision * (F.col("bad") + F.col("good")))).select("t.term", "t.stem", "bad").collect()
    stems_, words_ = {r["term"]: r["bad"] for r in rows if r["stem"]}, {r["term"]: r["bad"] for r in rows if not r["stem"]}
    terms = set()
    for root in stems_:
        if any(root[:k] in stems_ for k in range(_STEM_FROM, len(root))):
            continue
        own = [w for w in words_ if w.startswith(root)]
        # Mostly a few whole words: enter these. Otherwise any word that begins so counts.
        if own and sum(words_[w] for w in own) >= 0.9 * stems_[root] and len(own) <= 3:
            terms.update((w, False) for w in own)
        else:
            terms.add((root, True))
    return sorted(terms)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last one the intercept) of a logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[tuple[str, bool]], list[float]]:
    """Lexicon and weights. Only rows outside the held-out fifth are read as examples."""
    training = _training(docs, labels, max_labelled)
    terms = learn_lexicon(training)

    def per_batch(batch):
        lexicon = Lexicon(terms)
        rows = [features(t, lexicon) for t in batch.column(0).to_pylist()]
        yield dict(zip(FEATURES, map(list, zip(*rows, strict=True)), strict=True)) | {"toxic": batch.column(1)} if rows else {k: [] for k in (*FEATURES, "toxic")}

    schema = ", ".join(f"{k} double" for k in FEATURES) + ", toxic int"
    rows = map_rows(training.select("text", "toxic"), per_batch, schema).groupBy(*FEATURES, "toxic").count().collect()
    data = np.array([[*r] for r in rows], float).reshape(-1, len(FEATURES) + 2)
    if not len(data) or len(set(data[:, -2])) < 2:
        share = float(data[:, -2].mean()) if len(data) else 0.0
        return terms, [0.0] * len(FEATURES) + [10.0 if share > 0.5 else -10.0]
    times = data[:, -1].astype(int)
    return terms, fit(np.repeat(data[:, :-2], times, axis=0), np.repeat(data[:, -2], times)).tolist()


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score in [0, 1], predicted, and the counts behind the score.

    The lexicon and the weights come from at most `max_labelled` labelled rows whose crc32(doc_id) mod 5 is not 0
    (rows with another label than 0 or 1 are left out; several labels of a doc_id count as 1 if one is). Only the text
    is scored. Empty and missing texts get the score of a text without words. Without labels of both kinds every text
    gets the score of the only kind (0 without any). A missing doc_id stays missing, with held_out false.
    """
    terms, weights = train(docs, labels, max_labelled)

    def per_batch(batch):
        lexicon = Lexicon(terms)
        x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
        z = x @ np.array(weights[:-1]) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        counts = np.rint(np.expm1(x[:, :3])).astype(np.int32)
        yield {"doc_id": batch.column(0), "score": p, "hits": counts[:, 0], "near_hits": counts[:, 1], "quoted_hits": counts[:, 2]}

    scored = map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), per_batch,
        "doc_id long, score double, hits int, near_hits int, quoted_hits int",
    )
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "near_hits", "quoted_hits",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents that are not predicted toxic, all columns. Documents without doc_id are scored and filtered alike."""
    terms, weights = train(docs, labels, max_labelled)
    columns = docs.columns
    typed = docs.withColumn("_text", F.col("text"))

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        lexicon = Lexicon(terms)
        x = np.array([features(t, lexicon) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30))))

    return typed.where(scored("_text") < 0.5).select(columns)
