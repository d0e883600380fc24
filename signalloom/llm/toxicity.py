"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters. Some are fixed (a short list of insults, shouting); the lexicons of the others (whole words and word beginnings that
occur almost only in texts marked toxic: all with MIN_SUPPORT and MIN_PRECISION) are mined from at most MINING_ROWS labelled documents whose fold is not 0. Each
voter says yes or no to every document.

Label model. The votes of all documents of the training folds are counted by pattern (at most 2 ** voters of them). The
model has a class prior and, in each class, a tree of dependencies between voters: the tree of largest mutual information
given the class, so voters that copy each other do not count twice. Expectation-maximisation estimates prior, accuracies
and correlations; labels play no part in it. Every voter speaks for the toxic class by design, so to begin with each yes is
evidence for it, and in the clean class a yes is taken to be rare (CLEAN_YES, worth PRIOR_DOCS documents) whatever its parent says.

Classifier. Logistic regression over hit counts and rates, fitted to the posteriors of all documents of the training folds
by Newton steps whose sums are taken over partitions.

Cases: null and empty texts have no hits and get a score like any other; very long texts are looked at whole; units of equal
support are all kept, so ties decide nothing; without labels only the fixed voters can say yes;
repeated rows get equal scores; a doc_id with several labels takes the largest; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import fold, materialise, text_rows
from signalloom.llm.linear import matrix, partition_sums

FOLDS = 5
THRESHOLD = 0.5
MINING_ROWS = 40_000
MIN_SUPPORT = 4
MIN_PRECISION = 0.75
HELD_UNITS = 300_000
EM_ROUNDS = 60
MIN_RATE = 1 / 140
OFTEN_RATE = 1 / 80
CLEAN_YES = 0.01
PRIOR_DOCS = 50.0
FIRST_BELIEF = 0.5
NEWTON_STEPS = 12
LETTERS = re.compile(r"[^\W\d_]+")
#: Insults of the four languages of the corpus.
INSULTS = frozenset(
    """idiot moron stupid loser pathetic scum trash worthless disgusting clown dumb fool jerk imbecile dimwit scumbag
    abruti connard crétin imbécile débile ordure minable bouffon salaud tocard
    estúpido idiota imbécil tonto basura payaso cretino asqueroso patético escoria
    dummkopf trottel idiotisch blödmann arschloch abschaum versager widerlich schwachkopf depp""".split()
)
BEGINNINGS = {"begin7": 7, "begin6": 6, "begin5": 5, "begin4": 4}
KINDS = ("word", *BEGINNINGS)
VOTERS = ("insult", "word", "begin7", "begin6", "begin5", "begin4", "word_often", "begin_often", "two_kinds", "shouted_hit")
FEATURES = tuple(f"{k}_{x}" for k in ("insult", *KINDS) for x in ("any", "log", "rate")) + ("shouting", "log_words")


def units(words: Counter) -> dict[str, Counter]:
    """The text's distinct units of each kind with their counts."""
    out: dict[str, Counter] = {"word": words}
    for kind, size in BEGINNINGS.items():
        cut: Counter = Counter()
        for w, c in words.items():
            if len(w) >= size:
                cut[w[:size]] += c
        out[kind] = cut
    return out


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, unit, toxic, clean): documents of each label with the unit, summed while memory allows."""
    held: dict[tuple[int, str], list[int]] = {}

    def flush():
        keys = list(held)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [held[k][1] for k in keys]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "unit", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = units(Counter(LETTERS.findall((text or "").lower())))
            for i, kind in enumerate(KINDS):
                for unit in found[kind]:
                    held.setdefault((i, unit), [0, 0])[0 if label else 1] += 1
            if len(held) > HELD_UNITS:
                yield flush()
    yield flush()


def mine_lexicons(docs: DataFrame, labels: DataFrame, rows: int = MINING_ROWS) -> list[frozenset[str]]:
    """One lexicon per kind, from at most about `rows` labelled documents of the training folds, chosen by hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(fold(F.col("__doc"), FOLDS) != 0)
    there = known.count()
    if not there:
        return [frozenset() for _ in KINDS]
    part = int(1_000_000 * min(1.0, rows / there))
    chosen = known.filter(F.pmod(F.xxhash64("__doc"), F.lit(1_000_000)) < part)  # at most about `rows` rows of two numbers: small enough to broadcast
    joined = text_rows(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    counted = joined.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_mine, "kind int, unit string, toxic long, clean long")
    summed = counted.groupBy("kind", "unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = summed.filter((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") / (F.col("toxic") + F.col("clean") + 0.5) >= MIN_PRECISION))
    # every unit of support and precision; what the rows of the sample hold, by MIN_SUPPORT, bounds their number at any size of the corpus
    found = strong.select("kind", "unit").collect()
    return [frozenset(r["unit"] for r in found if r["kind"] == i) for i in range(len(KINDS))]


class Voters:
    """Votes and features of a text, given the lexicons."""

    def __init__(self, lexicons: list[frozenset[str]]):
        self.lexicons = dict(zip(KINDS, lexicons, strict=True))

    def look(self, text: str) -> tuple[int, list[float]]:
        raw = LETTERS.findall(text)
        words = Counter(map(str.lower, raw))
        n = max(len(raw), 1)
        hits = {"insult": sum(c for w, c in words.items() if w in INSULTS)}
        for kind, size in (("word", None), *BEGINNINGS.items()):
            lexicon = self.lexicons[kind]
            hits[kind] = sum(c for w, c in words.items() if w[:size] in lexicon) if lexicon else 0
        shouting = sum(map(str.isupper, raw)) / n
        # a lexicon word now and then is chance in a long text: a voter asks for a share of the words
        some, often = max(1, n * MIN_RATE), max(2, n * OFTEN_RATE)
        begun = max(hits[k] for k in BEGINNINGS)
        kinds = (hits["insult"] >= some) + (hits["word"] >= some) + (begun >= some)
        votes = (hits["insult"] >= some, hits["word"] >= some, *(hits[k] >= some for k in BEGINNINGS), hits["word"] >= often, begun >= often, kinds > 1, shouting > 0.5 and kinds > 0)
        features = [x for h in hits.values() for x in (float(h >= some), float(np.log1p(h)), min(1.0, 20 * h / n))]
        return sum(1 << i for i, v in enumerate(votes) if v), [*features, shouting, float(np.log1p(len(raw)))]


def _look(lexicons: list[frozenset[str]]):
    voters = Voters(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looked = [voters.look(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[0] for x in looked], pa.int32()), pa.array([x[1] for x in looked], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "votes", "features"])

    return run


class LabelModel:
    """Prior, class-conditional tree of voters, and the posterior of each pattern of votes."""

    def __init__(self, patterns: dict[int, int], voters: int = len(VOTERS), rounds: int = EM_ROUNDS):
        self.keys = np.asarray(sorted(patterns), dtype=np.int64)
        weight = np.asarray([patterns[int(k)] for k in self.keys], dtype=np.float64)
        votes = (self.keys[:, None] >> np.arange(voters)) & 1
        post = np.clip(1 - (1 - FIRST_BELIEF) ** votes.sum(1), 0.001, 0.999)
        total = max(weight.sum(), 1.0)
        self.parents, self.prior = [-1] * voters, 0.5
        self.tables = np.full((voters, 2, 2), 0.5)
        for step in range(rounds if len(votes) else 0):
            mass = np.stack([weight * (1 - post), weight * post])
            self.prior = float(np.clip(mass[1].sum() / total, 1e-6, 1 - 1e-6))
            if step % 10 == 0:
                self.parents = self._tree(votes, mass)
            self.tables = self._fit(votes, mass)
            new = self._posterior(votes)
            if np.abs(new - post).max() < 1e-6 and step % 10:
                post = new
                break
            post = new
        self.post = post

    @staticmethod
    def _tree(votes: np.ndarray, mass: np.ndarray) -> list[int]:
        """Chow and Liu's tree on mutual information given the class."""
        m = votes.shape[1]
        gain = np.zeros((m, m))
        total = mass.sum()
        for y in range(2):
            ny = max(mass[y].sum(), 1e-9)
            for i in range(m):
                for j in range(i):
                    for a in range(2):
                        for b in range(2):
                            p = mass[y][(votes[:, i] == a) & (votes[:, j] == b)].sum() / ny
                            pa_, pb = mass[y][votes[:, i] == a].sum() / ny, mass[y][votes[:, j] == b].sum() / ny
                            if p > 0:
                                gain[i, j] = gain[j, i] = gain[i, j] + ny / total * p * np.log(p / (pa_ * pb))
        parents, inside = [-1] * m, {0}
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: gain[e])
            parents[j] = i
            inside.add(j)
        return parents

    def _fit(self, votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """P(vote = 1 | vote of the parent, class), with the prior's documents in the clean class and one in the toxic class."""
        out = np.zeros((votes.shape[1], 2, 2))
        for j, parent in enumerate(self.parents):
            for y in range(2):
                for a in range(2):
                    at = votes[:, parent] == a if parent >= 0 else np.ones(len(votes), dtype=bool)
                    yes, docs = (0.5, 1.0) if y else (CLEAN_YES * PRIOR_DOCS, PRIOR_DOCS)
                    out[j, a, y] = (mass[y][at & (votes[:, j] == 1)].sum() + yes) / (mass[y][at].sum() + docs)
        return out

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.asarray([1 - self.prior, self.prior]))[None, :].repeat(len(votes), 0)
        for j, parent in enumerate(self.parents):
            p = self.tables[j, votes[:, parent] if parent >= 0 else 0]
            log = log + np.log(np.where(votes[:, j : j + 1] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        return self.post[np.searchsorted(self.keys, patterns)] if len(self.keys) else np.zeros(len(patterns))


def fit_logistic(rows: DataFrame, model: LabelModel, steps: int = NEWTON_STEPS, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) on the posterior of each row's vote pattern."""
    width = 1 + len(FEATURES)
    w = np.zeros(width)
    for _ in range(steps):

        def newton(batch, w=w):
            x = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch.column(1), len(FEATURES))])
            y = model.posteriors(batch.column(0).to_numpy())
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        sums = partition_sums(rows, newton, width + width * width)
        penalty = np.full(width, ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve(sums[width:].reshape(width, width) + np.diag(penalty), sums[:width] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    lexicons = mine_lexicons(docs, labels)
    rows = text_rows(docs)
    looked = materialise(rows.mapInArrow(_look(lexicons), "doc_id long, votes int, features array<double>"), "votes")
    train = looked.filter(fold(F.col("doc_id"), FOLDS) != 0)
    patterns = {r["votes"]: r["n"] for r in train.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** voters rows
    w = fit_logistic(train.select("votes", "features"), LabelModel(patterns))
    scored = looked.select("doc_id", "features").mapInArrow(_score(w), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
