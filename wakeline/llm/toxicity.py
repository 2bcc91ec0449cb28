"""Toxicity by nearest labelled examples.

fit() takes a bounded sample of labelled rows (PER_CLASS of each label, by a hash of the id); executors count their words, and
the driver gets words and counts, never texts. TF-IDF vectors are made over all of their words, so every example with a
word can be found. Words that tell label 1 (near copies share one vote) weigh more, by how sure that is; their beginnings and
repeated forms are terms of their own. The examples lie in an inverted index
cut into blocks: each posting list knows the largest weight in each block, so a bound on the cosine of a whole block
is known without reading it, and blocks are read in falling order of their bounds until none can hold a nearer
example: the NEIGHBOURS found are exact. Their cosines are the weights of their votes, and a monotone map
turns votes into probabilities at the natural rate of the labels. The map is fitted on votes for examples that had no part in
choosing terms, weights or neighbours: the examples are dealt to FOLDS parts, copies to the same, and each part is voted on by
the others. Texts without any word of an example have the rate of such texts among the examples, or of label 1; texts with just an
example's words have its label. The neighbours are returned as evidence.

Labels are learnt only from rows whose crc32 of the id as text, modulo 4, is not 2. Inputs of a score are the text's
words alone.

Defined results: null and empty texts have no words; an id with several labels has the largest, an id with several texts the least
of them; labels other than 0 and 1, and null ids, are not learnt from; without examples of both labels every score is 0; equal
cosines are ordered by the example's id; repeated rows, extra columns and empty tables do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settle, small_batches, spare, stage, trim
from .neardup import bands, samples
from .wordhash import shingles, utf8, words

#: The bound of what is learnt from and gathered: the different words of so many examples of each label.
PER_CLASS = 2000
#: Parts in which each label's examples come to the driver, one job each.
PARTS = 8
#: Evidence that gives a word its full weight (beginnings and repeated forms count from there on), and the weight of words without any.
LEAST_Z, LEAST_RATIO, POWER, PLAIN = 3.4, 4.0, 4, 0.02
BEGINNINGS = (4, 5, 6)
#: A mark that a text has so often is a mark of its own.
OFTEN = (2, 4)
NEIGHBOURS, BLOCK, FOLDS = 15, 64, 4
#: Rows at the natural rate that are added to each rate of the map of votes.
PRIOR = 4
#: The share of MinHash samples that near copies have in common.
COPIES = 0.8
#: Blocks that are read before a bound is tried; then four times as many each time.
FIRST_BLOCKS = 8
#: Terms that are held as rows of a matrix at most; entries that are looked through at once, where one text has no more; texts that are scored together.
COMMON, ENTRIES, TOGETHER = 256, 1 << 16, 64
THRESHOLD = 0.3
#: The cosine from which two vectors are equal.
SAME = 1 - 1e-9
_WORD = re.compile(r"\w+")


def word_marks(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def sampled(texts: list[str | None]) -> list[np.ndarray | None]:
    """MinHash samples of each text's five-word shingles; None without a word."""
    made, cuts = shingles(*words(*utf8(pa.array(texts, pa.large_string()))), 5)
    rows = iter(samples(made, cuts))
    return [next(rows) if has else None for has in np.diff(cuts) > 0]


def copy_groups(sample: list[np.ndarray | None]) -> np.ndarray:
    """Each example's group of near copies: rows that share a band with one of the group and COPIES of its samples."""
    root = np.arange(len(sample))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    #: of each bucket, rows that aren't near copies of each other
    seen: dict[int, list[int]] = {}
    for i, row in enumerate(sample):
        if row is None:
            continue
        tried: dict[int, bool] = {}
        for key in bands(row[None])[0].tolist():
            held = seen.setdefault(key, [])
            for j in held:
                if j not in tried:
                    tried[j] = float((row == sample[j]).mean()) >= COPIES
                if tried[j]:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                    break
            else:
                held.append(i)
    return np.array([find(i) for i in range(len(sample))], np.int64)


def often(tf: dict[str, int]) -> list[str]:
    """Marks with their repeated forms."""
    return [*tf, *(f"{m}#{k}" for m, n in tf.items() if n > 1 for k in OFTEN if n >= k)]


def evidence(a, b, n: list[float]):
    """How sure it is that a mark tells label 1 (z of the log odds), and how many times as frequent it is there: a of n[1] against b of n[0]."""
    odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
    return odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), a / n[1] / np.maximum(b / n[0], 1e-12)


def emphasis(a: np.ndarray, b: np.ndarray, n: list[float]) -> np.ndarray:
    """The factor of each mark's weight: 1 from LEAST_Z on, less for weaker evidence, PLAIN where there is none."""
    z, ratio = evidence(a, b, n)
    return np.where(ratio > LEAST_RATIO, np.clip(z / LEAST_Z, 0, 1) ** POWER, 0).clip(min=PLAIN)


#: A sparse vector: terms to weights, or arrays of both.
Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]


def pair(vector: Vector) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([*vector], np.int64), np.array([*vector.values()], float)) if isinstance(vector, dict) else vector


class BlockMaxIndex:
    """Exact nearest rows of a sparse matrix of unit vectors by cosine."""

    def __init__(self, vectors: Iterable[Vector], block: int = BLOCK):
        sizes, terms, weights = [], [np.zeros(0, np.int32)], [np.zeros(0)]
        for term, weight in map(pair, vectors):
            sizes.append(len(term))
            terms.append(term.astype(np.int32))
            weights.append(weight)
        term, weight, row = np.concatenate(terms), np.concatenate(weights), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.n, self.block, self.blocks = len(sizes), block, -(-len(sizes) // block)
        order = np.argsort(term, kind="stable")
        term, self.rows, self.weights = term[order], row[order], weight[order]
        # a run is what a term has in a block; runs lie by term, then by block
        of = self.rows // block
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(of, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.of, self.cuts = of[first], np.append(first, len(term))
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.runs = np.searchsorted(term[first], np.arange(int(term.max(initial=-1)) + 2))
        # terms that most blocks have: their lists are written out as rows of matrices, with zeros
        spread = np.diff(self.runs)
        self.common = np.argsort(-spread, kind="stable")[: min(COMMON, int((2 * spread >= max(self.blocks, 2)).sum()))]
        self._whole = None

    def __getstate__(self):
        return {**self.__dict__, "_whole": None}

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each term among the common ones (-1: none), and their weights by row and largest weights by block."""
        if self._whole is None:
            place = np.full(len(self.runs) - 1, -1, np.int64)
            place[self.common] = np.arange(len(self.common))
            rows, most = np.zeros((len(self.common), self.n)), np.zeros((len(self.common), self.blocks))
            for i, t in enumerate(self.common.tolist()):
                run = slice(self.runs[t], self.runs[t + 1])
                most[i, self.of[run]] = self.most[run]
                at = slice(self.cuts[self.runs[t]], self.cuts[self.runs[t + 1]])
                rows[i, self.rows[at]] = self.weights[at]
            self._whole = place, rows, most
        return self._whole

    def nearest(self, vectors: list[Vector], k: int) -> list[list[tuple[float, int]]]:
        """For each vector (cosine, row) of the k rows of largest positive cosine, the smaller row first among equals."""
        pairs = []
        for vector in vectors:
            terms, weights = pair(vector)
            known = terms < len(self.runs) - 1
            pairs.append((terms[known], weights[known]))
        upto = np.cumsum([0, *(int((self.runs[t + 1] - self.runs[t]).sum()) + self.n for t, _ in pairs)])
        out, at = [], 0
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + ENTRIES, side="right")) - 1)
            out += self._nearest(pairs[at:to], k)
            at = to
        return out

    def _nearest(self, pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        best: list[list[tuple[float, int]]] = [[] for _ in pairs]
        place, rows, most = self.whole()
        terms, weights, owner = np.concatenate([t for t, _ in pairs]), np.concatenate([x for _, x in pairs]), np.repeat(np.arange(len(pairs)), [len(t) for t, _ in pairs])
        if not len(terms):
            return best
        here = place[terms] >= 0
        common = np.zeros((len(pairs), len(rows)))
        common[owner[here], place[terms[here]]] = weights[here]
        base = common @ rows
        terms, weights, owner = terms[~here], weights[~here], owner[~here]
        start = self.runs[terms]
        size = self.runs[terms + 1] - start
        run = _ranges(start, size)
        w, cell = np.repeat(weights, size), np.repeat(owner * self.blocks, size) + self.of[run]
        bound = common @ most + np.bincount(cell, w * self.most[run], len(pairs) * self.blocks).reshape(-1, self.blocks)
        order = np.argsort(-bound, axis=1, kind="stable")
        least = np.zeros(len(pairs))
        at, step = 0, FIRST_BLOCKS
        while at < self.blocks:
            take = order[:, at : at + step]
            wanted = np.take_along_axis(bound, take, axis=1)
            wanted = (wanted > 0) & (wanted >= least[:, None])
            if not wanted.any():
                break
            read = np.zeros(bound.shape, bool)
            np.put_along_axis(read, take, wanted, axis=1)
            here = np.flatnonzero(read.ravel()[cell])
            n = self.cuts[run[here] + 1] - self.cuts[run[here]]
            places = _ranges(self.cuts[run[here]], n)
            scores = np.bincount(np.repeat(cell[here] // self.blocks * self.n, n) + self.rows[places], np.repeat(w[here], n) * self.weights[places], len(pairs) * self.n).reshape(-1, self.n) + base
            scores[~np.repeat(read, self.block, axis=1)[:, : self.n]] = 0
            for i in np.flatnonzero(wanted.any(axis=1)).tolist():
                mine = scores[i]
                hit = np.flatnonzero(mine > max(least[i] - 1e-9, 0.0))
                if len(hit) > 4 * k:
                    hit = hit[mine[hit] >= np.partition(mine[hit], -k)[-k] - 1e-9]
                best[i] = sorted(best[i] + [(-round(x, 12), row) for x, row in zip(mine[hit].tolist(), hit.tolist(), strict=True)])[:k]
                if len(best[i]) == k:
                    least[i] = -best[i][-1][0] - 1e-12
            at, step = at + step, 4 * step
        return [[(-x, row) for x, row in found] for found in best]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] places, and so on."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Terms:
    """Numbers for all marks of the examples, and each example's marks with how often it has them.

    Examples of label 1 come first: beginnings and repeated forms are numbered only where label 1 has them, which keeps the tables small.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, bag: dict[str, int], label: int) -> None:
        number, tf = self.number, {}
        for word, k in bag.items():
            number.setdefault(word, len(number))
            for mark in word_marks(word):
                tf[mark] = tf.get(mark, 0) + k
        marks = {m: tf[m.partition("#")[0]] for m in often(tf)}
        if label == 1:
            for m in marks:
                number.setdefault(m, len(number))
        known = {t: k for m, k in marks.items() if (t := number.get(m)) is not None}
        terms = np.fromiter(known, np.int32, len(known))
        order = np.argsort(terms)
        self.rows.append((terms[order], np.fromiter(known.values(), np.int32, len(known))[order]))

    def close(self) -> Terms:
        self.names = list(self.number)
        self.word = np.array([m[-1] != "*" and "#" not in m for m in self.names], bool)
        return self


class Neighbours:
    """Examples in an index of TF-IDF vectors, and votes of the nearest."""

    def __init__(self, terms: Terms, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray, groups: np.ndarray, of: np.ndarray):
        """of: the examples to learn from; weight: what an example of each label counts for; groups: of near copies."""
        rows = [terms.rows[i] for i in of]
        self._pick(terms, rows, labels[of], 1.0 / np.bincount(groups[of])[groups[of]])
        held = [self.known(x) for x in rows]
        df = np.bincount(np.concatenate([t for t, _ in held]), minlength=len(self.scale))
        self.scale *= np.log((len(of) + 1) / (1 + df)) + 1
        strongest = np.array([t[np.argmax(self._unit(t, n))] if len(t) else -1 for t, n in held])
        # rows with the same strongest mark lie together, which makes blocks' bounds tight
        order = sorted(np.flatnonzero(strongest >= 0).tolist(), key=lambda i: (strongest[i], ids[of[i]]))
        self.ids, self.labels = ids[of[order]].tolist(), labels[of[order]]
        self.weights = weight[self.labels]
        self.index = BlockMaxIndex((held[i][0], self._unit(*held[i])) for i in order)

    def _pick(self, terms: Terms, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, copies: np.ndarray) -> None:
        """The marks and their factors: every word of an example, and the beginnings and repeated forms that tell label 1."""
        n = [float(copies[labels == y].sum()) for y in (0, 1)]
        size = len(terms.names)
        support = [np.zeros(size), np.zeros(size)]
        for (found, _), label, share in zip(rows, labels.tolist(), copies.tolist(), strict=True):
            support[label][found] += share
        b, a = support
        with np.errstate(divide="ignore"):
            z, ratio = evidence(a, b, n)
        sure = np.flatnonzero((z > LEAST_Z) & (ratio > LEAST_RATIO) & ((a > 1) | terms.word))
        names = [terms.names[i] for i in sure]
        # a beginning says no more than a longer mark that nearly all of its support has
        longer: dict[str, float] = {}
        for i, mark in zip(sure.tolist(), names, strict=True):
            if "#" not in mark:
                for k in range(BEGINNINGS[0], len(mark.rstrip("*")) + (not mark.endswith("*"))):
                    longer[mark[:k]] = max(longer.get(mark[:k], 0.0), a[i])
        weak = {m for i, m in zip(sure.tolist(), names, strict=True) if m.endswith("*") and longer.get(m[:-1], 0.0) >= 0.9 * a[i]}
        self.chosen = terms.word & (a + b > 0)
        for i, m in zip(sure.tolist(), names, strict=True):
            self.chosen[i] |= m.partition("#")[0] not in weak
        self.scale = np.where(self.chosen, emphasis(a, b, n), 0.0)

    def named(self, terms: Terms) -> Neighbours:
        """With the names of the marks, which texts that aren't examples need."""
        self.marks = {terms.names[i]: i for i in np.flatnonzero(self.chosen).tolist()}
        self.beginnings = {m.partition("#")[0] for m in self.marks if "*" in m}
        self.openings = {m[: BEGINNINGS[0]] for m in self.beginnings}
        self.repeated = {m.partition("#")[0] for m in self.marks if "#" in m}
        return self

    def known(self, row: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The marks of an example that are chosen."""
        here = self.chosen[row[0]]
        return row[0][here].astype(np.int64), row[1][here].astype(float)

    def tf(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Marks of a bag of words, and how often it has each."""
        tf: dict[int, int] = {}
        found: dict[str, int] = {}
        marks, beginnings, repeated, (a, b, c) = self.marks, self.beginnings, self.repeated, BEGINNINGS
        for word, k in bag.items():
            size = len(word)
            if (t := marks.get(word)) is not None:
                tf[t] = k
                if word in repeated:
                    found[word] = k
            if size > a and (m := word[:a]) in self.openings:
                if (m := m + "*") in beginnings:
                    found[m] = found.get(m, 0) + k
                if size > b:
                    if (m := word[:b] + "*") in beginnings:
                        found[m] = found.get(m, 0) + k
                    if size > c and (m := word[:c] + "*") in beginnings:
                        found[m] = found.get(m, 0) + k
        for m in often(found):
            if (t := marks.get(m)) is not None:
                tf[t] = found[m.partition("#")[0]]
        terms = np.fromiter(tf, np.int64, len(tf))
        order = np.argsort(terms)
        return terms[order], np.fromiter(tf.values(), float, len(tf))[order]

    def _unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights of a unit TF-IDF vector."""
        out = (1 + np.log(tf)) * self.scale[terms]
        return out / math.sqrt(float(out @ out)) if len(out) else out

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector of a bag of words over the marks: marks and weights."""
        terms, tf = self.tf(bag)
        return terms, self._unit(terms, tf)

    def nearest(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int]]]:
        """(cosine, place) of the nearest examples of each row of marks and how often it has them."""
        return self.index.nearest([(terms, self._unit(terms, tf)) for terms, tf in rows], NEIGHBOURS)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 in the neighbours' cosines, each at its label's natural weight."""
        each = [(s * self.weights[row], self.labels[row]) for s, row in near]
        return sum(x for x, y in each if y) / sum(x for x, _ in each)


class Model:
    """Neighbours and the map of their votes to probabilities."""

    def __init__(self, examples: Iterable[tuple[int, dict[str, int], np.ndarray | None, int]], rate: float):
        """examples: (id, words, MinHash samples, label), label 1 first; rate: the share of label 1 among all labelled rows."""
        self.neighbours, self.empty = None, 0.0
        self.steps, self.levels = np.array([0.0]), np.array([0.0])
        terms, known = Terms(), []
        for i, bag, sample, label in examples:
            terms.add(bag, label)
            known.append((i, sample, label))
        order = sorted(range(len(known)), key=lambda i: known[i][0])
        known, terms.rows = [known[i] for i in order], [terms.rows[i] for i in order]
        ids, labels = np.array([x[0] for x in known], np.int64), np.array([x[2] for x in known], np.int64)
        n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
        if not n.all():
            return
        terms.close()
        weight = np.array([(1 - rate) / n[0], rate / n[1]])
        groups = copy_groups([x[1] for x in known])
        votes = np.full(len(ids), np.nan)
        # groups are dealt to folds label by label, as they come by id
        fold = np.zeros(len(ids), np.int64)
        for y in (0, 1):
            firsts, place = np.unique(groups[labels[groups] == y], return_inverse=True)
            fold[labels[groups] == y] = (np.arange(len(firsts)) % FOLDS)[place]
        for k in range(FOLDS):
            of, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(out) and 0 < labels[of].sum() < len(of):
                others = Neighbours(terms, ids, labels, weight, groups, of)
                for i, near in zip(out.tolist(), others.nearest([others.known(terms.rows[i]) for i in out]), strict=True):
                    if near:
                        votes[i] = others.vote(near)
        self.neighbours = Neighbours(terms, ids, labels, weight, groups, np.arange(len(ids))).named(terms)
        weights = weight[labels]
        none = np.array([not len(x) for x, _ in terms.rows])
        self.empty = float(((none & (labels == 1)).sum() * weight[1] + rate * weight.min()) / ((weights * none).sum() + weight.min()))
        voted = ~np.isnan(votes)
        self._calibrate(votes[voted], labels[voted], weights[voted])

    def _calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Pool adjacent violators: the monotone map of votes to rates."""
        pools: list[list[float]] = []
        for v in np.unique(votes):
            at = votes == v
            pools.append([v, float((weights * labels)[at].sum()), float(weights[at].sum())])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                top = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
        if pools:
            unit, rate = float(weights.min()), float((weights * labels).sum() / weights.sum())
            self.steps = np.array([p[0] for p in pools])
            self.levels = np.maximum.accumulate([(p[1] + PRIOR * rate * unit) / (p[2] + PRIOR * unit) for p in pools])

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """The calibrated score of each text, and the ids of the neighbours it rests on."""
        if self.neighbours is None:
            return [(0.0, [])] * len(texts)
        return list(map(self._score, self.neighbours.nearest([self.neighbours.tf(counts(x)) for x in texts])))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return self.scores([text])[0]

    def _score(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        if not near:
            return self.empty, []
        evidence = [self.neighbours.ids[row] for _, row in near]
        # examples of the very same words settle it alone
        if near[0][0] >= SAME:
            return self.neighbours.vote([x for x in near if x[0] >= SAME]), evidence
        at = int(np.searchsorted(self.steps, self.neighbours.vote(near) + 1e-12, side="right")) - 1
        return float(min(1.0, self.levels[max(at, 0)])), evidence


def described(rows: list[tuple[int, str | None, int]]) -> list[tuple[int, Counter, np.ndarray | None, int]]:
    """Examples as Model takes them, from (id, text, label)."""
    rows = sorted(rows, key=lambda x: -x[2])
    return [(i, counts(t), sample, y) for (i, t, y), sample in zip(rows, sampled([t for _, t, _ in rows]), strict=True)]


def _describe(batches):
    for b in batches:
        for i, bag, sample, y in described(list(zip(*(c.to_pylist() for c in b.columns), strict=True))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.array([list(bag)], pa.list_(pa.string())), pa.array([list(bag.values())], pa.list_(pa.int64())), pa.array([None if sample is None else sample.tobytes()], pa.binary()), pa.array([y], pa.int32())],
                ["id", "words", "n", "sample", "label"],
            )
    trim()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """What reaches the driver: one row of rates, and of 2 * per_class examples the different words, counts and MinHash samples."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    n = dict(known.groupBy("label").count().collect())
    picked = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(per_class).collect()]
    if not n.get(0) or not n.get(1):
        return Model([], 0.0)
    chosen = docs.sparkSession.createDataFrame(picked, known.schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    made = texts.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(_describe, "id long, words array<string>, n array<long>, sample binary, label int")
    made = stage(made, "toxicity-examples")
    settle(docs.sparkSession)

    def examples():
        for y in (1, 0):
            for r in made.filter(F.col("label") == y).coalesce(PARTS).toLocalIterator():
                yield r.id, dict(zip(r.words, r.n, strict=True)), None if r.sample is None else np.frombuffer(r.sample, np.uint64), r.label

    model = Model(examples(), n[1] / (n[0] + n[1]))
    settle(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """keep, score, predicted and evidence (ids of the labelled neighbours); prefix goes before the new names."""
    small_batches(docs.sparkSession)
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        many = carried.value.scores
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            made = [x for at in range(0, len(texts), TOGETHER) for x in many(texts[at : at + TOGETHER])]
            value = np.array([x[0] for x in made], float)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array([x[1] for x in made], pa.list_(pa.int64()))], [*keep, f"{prefix}score", f"{prefix}predicted", f"{prefix}evidence"]
            )
        trim()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias(spare(keep, "_text"))).mapInArrow(run, f"{kinds}, {prefix}score double, {prefix}predicted int, {prefix}evidence array<long>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
