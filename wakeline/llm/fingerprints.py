"""Document fingerprints by MinHash.

A text has two sets, whatever its length: its runs of five words (A-Z lower-cased), and its runs of RUN_BYTES bytes, as
a few words leave too few word shingles to tell texts apart. Universal hash functions (a * x + b modulo 2**64, upper half)
give the least value over a set each; the fingerprint holds 16 bits of each, PERMUTATIONS of them for words and then
RUN_PERMUTATIONS for bytes. Like is compared with like: the share of equal places estimates the mean of both sets'
Jaccard similarities, weighted by their places.

similar_groups() joins bands of the fingerprints' word part in Spark and verifies the Jaccard similarity on full shingle sets
(query similar_documents); hot buckets are handled as in neardup.

Defined results: null and empty texts, and texts without a word, have the fingerprint of the empty set, alike only to itself; a table of one
row is its own neighbour; repeated ids are ordered by text; null ids come last in descending order; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .neardup import Scheme, near_duplicates, near_sql
from .ranges import range_bounds, range_of, runs
from .wordhash import mix, shingles, utf8, words

PERMUTATIONS, RUN_PERMUTATIONS = 128, 64
SHINGLE_WORDS, RUN_BYTES = 5, 6
#: Bytes of the texts whose runs are held at once, where a single text isn't longer.
HELD_BYTES = 1 << 16
#: Bytes of a band of the word part: 32 bands of 4 places.
BAND_BYTES = 8
_seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _seeds[:PERMUTATIONS] | np.uint64(1), _seeds[PERMUTATIONS:]


def byte_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of RUN_BYTES bytes of each text, and each text's first (and the end); a shorter text is one run."""
    size = np.diff(bounds)
    many = np.where(size >= RUN_BYTES, size - RUN_BYTES + 1, np.minimum(size, 1))
    cuts = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=cuts[1:])
    low = np.concatenate([data + ((data >= 65) & (data <= 90)) * np.uint8(32), np.zeros(RUN_BYTES, np.uint8)]).astype(np.uint64)
    n = len(data)
    gram = np.zeros(n, np.uint64)
    for k in range(RUN_BYTES):
        gram = gram * np.uint64(256) + low[k : n + k]
    at = np.arange(cuts[-1]) + np.repeat(bounds[:-1] - cuts[:-1], many)
    length = np.repeat(np.minimum(size, RUN_BYTES), many).astype(np.uint64)
    # a short text's run ends with the text
    gram = (gram[at] >> (np.uint64(8) * (np.uint64(RUN_BYTES) - length))) + (length << np.uint64(56))
    return mix(gram + np.uint64(0xC2B2AE3D27D4EB4F)), cuts


def minima(first: np.ndarray, k: int, held: np.ndarray) -> np.ndarray:
    """The least value of universal hash function k over the sets that begin at first; held[0] has the shingles, held[1] is room."""
    np.multiply(held[0], _A[k], out=held[1])
    np.add(held[1], _B[k], out=held[1])
    np.right_shift(held[1], np.uint64(32), out=held[1])
    return np.minimum.reduceat(held[1], first)


def signatures(made: np.ndarray, cuts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of 16-bit values for each text, one for each permutation; the empty set's are all 0xFFFF."""
    out = np.full((len(cuts) - 1, permutations), 0xFFFF, np.uint16)
    has = np.flatnonzero(np.diff(cuts))
    if len(has):
        first, held = cuts[:-1][has], np.stack([made >> np.uint64(32), made])
        for k in range(permutations):
            # of the least 32-bit value, 16 mixed bits are kept
            out[has, k] = (mix(minima(first, k, held)) >> np.uint64(48)).astype(np.uint16)
    return out


def signatures_of(texts: pa.Array) -> np.ndarray:
    data, bounds = utf8(texts)
    hashes, index = words(data, bounds)
    by_words = signatures(*shingles(hashes, index, SHINGLE_WORDS))
    by_bytes = np.full((len(by_words), RUN_PERMUTATIONS), 0xFFFF, np.uint16)
    at = 0
    while at < len(by_words):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HELD_BYTES, side="right")) - 1)
        by_bytes[at:to] = signatures(*byte_runs(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]), RUN_PERMUTATIONS)
        at = to
    by_bytes[np.diff(index) == 0] = 0xFFFF
    return np.concatenate([by_words, by_bytes], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the following text (or all of it)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of ids in descending order; each range ends with a copy of the row that follows it (carried = true).

    The row after the last is the first. Texts are shuffled once; only one row a range is doubled. There are ranges.MOST_RANGES
    ranges at most; rows of one id lie in one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = np.unique(range_bounds(rows, "doc_id", 512, 16_384))

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(b.column(0), bounds)), b.column(0)], ["range", "doc_id"])

    # one row for each range
    ends = sorted(rows.select("doc_id").mapInArrow(placed, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("hi")).collect(), key=lambda r: r["range"])
    # the row that follows the end of a range has the largest id of the range below it; a range of null ids only has none
    receivers: dict[int | None, list[int]] = {}
    for i, r in enumerate(ends):
        receivers.setdefault(ends[i - 1]["hi"], []).append(r["range"])

    def dealt(batches):
        for b in batches:
            keys = b.column(0)
            home = range_of(keys, bounds)
            hits = [(i, to) for i, x in enumerate(keys.to_pylist()) for to in receivers.get(x, ())]
            take = pa.array([*range(b.num_rows), *(i for i, _ in hits)], pa.int64())
            where = pa.array(np.concatenate([home, np.array([to for _, to in hits], np.int32)]), pa.int32())
            carried = pa.array(np.arange(len(take)) >= b.num_rows)
            yield pa.RecordBatch.from_arrays([where, carried, keys.take(take), b.column(1).take(take)], ["range", "carried", "doc_id", "text"])

    out = rows.mapInArrow(dealt, "range int, carried boolean, doc_id long, text string").repartitionById(len(bounds) + 1, F.col("range"))
    return out.sortWithinPartitions("range", "carried", F.col("doc_id").desc_nulls_last(), "text")


def _pairs(batches):
    """Batches of (ids, texts, following texts), in descending order of ids."""
    for _, parts in runs(batches, "range"):
        ids, texts, done = [], [], False
        for b in parts:
            if done:
                continue
            carried = b.column("carried").to_numpy(zero_copy_only=False)
            n = int(np.argmax(carried)) + 1 if carried.any() else b.num_rows
            done = bool(carried.any())
            ids += b.column("doc_id").to_pylist()[:n]
            texts += [x or "" for x in b.column("text").to_pylist()[:n]]
            for at in range(0, len(texts) - 1, 100):
                to = min(at + 100, len(texts) - 1)
                yield ids[at:to], texts[at:to], texts[at + 1 : to + 1]
            ids, texts = ids[-1:], texts[-1:]
        if ids and not done:  # all ids of the table are null
            yield ids, texts, texts


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches):
        for ids, texts, following in _pairs(batches):
            changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
            own, other = signatures_of(pa.array([*texts, following[-1]], pa.large_string())), signatures_of(pa.array(changed, pa.large_string()))
            text = lambda rows: pa.array([x.tobytes().hex() for x in rows.astype(">u2")])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    text(own[:-1]), text(other), pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes().hex() for x in signatures_of(part.column(1)).astype(">u2")])], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _bands(made: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of the fingerprint's word part, and the part itself, of each set that isn't empty."""
    whole = signatures(made, cuts)[np.diff(cuts) > 0].view("<u8")
    return mix(whole + np.arange(1, whole.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), whole.view(np.int64)


def _bit_bound(percent: int) -> int:
    """Bits in which the word parts of a linked pair differ at most: half of a place's 16 bits where places differ, and eight deviations."""
    off = 1 - percent / 100
    return int(8 * (PERMUTATIONS * off + 8 * np.sqrt(PERMUTATIONS * off * (1 - off) + PERMUTATIONS * off / 16)))


BANDED = Scheme(_bands, _bit_bound, 0)


def similar_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of similar documents, by bands of the fingerprints' word parts joined in Spark and
    Jaccard similarities verified on full sets of five-word shingles. 32 bands of 4 miss a pair at 0.8 with probability 5e-8."""
    return near_duplicates(docs, size=SHINGLE_WORDS, percent=percent, scheme=BANDED)


#: The same groups by all shared shingles.
GROUPS_SQL = f"WITH RECURSIVE {near_sql('documents', SHINGLE_WORDS)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near_"


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir))
