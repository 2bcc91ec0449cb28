"""MinHash near-duplicates with odd sketches.

1. One pass over the texts: a key of the whole word sequence (equal: copies), the set's size, one-permutation
   MinHash samples (an empty bin takes the sample of the first occupied one in an order of its own), their bands, and an odd
   sketch: every sample toggles one bit of a bitmap. The XOR of two sketches has a bit for each bin hit by an odd
   number of differing samples, so its population count tells the similarity, most sharply near 1.
2. Copies collapse to their smallest id. Bands of these go to buckets; buckets of one are dropped.
3. Every row is compared with one hub of its buckets, first with the most central row it shares one with (the one
   with the most rows in its buckets), and linked rows become one component. What is left in buckets with more than
   one component, the rows outside the largest one, are then compared with all rows of the bucket that are not in
   their component, once for each pair, in blocks. So a large group of near copies costs a few comparisons a row, and no link is
   given up: a pair that isn't compared is in one component already.
4. A pair is compared by size, then sketch (from SURE shingles on; smaller sets go straight on), then exactly on full shingle sets.

With 64 bands of 8 samples a pair at the threshold 0.8 is in no common bucket with probability 8e-6. Its sketches differ
in 186 bits on average with a deviation of 19 at most (measured for unions of 5 to 2,000 shingles); SPREAD deviations over
that is the bound, which is passed with a probability below 1e-14. Under SURE shingles a few samples in the same bin move the
count by more than that, so there the sketch isn't asked.

Texts that share most of their words meet in buckets without being linked. So a pair of what is left in buckets is also held
against an odd sketch of its whole sets, one bit toggled for each shingle: every bit of the XOR stands for a shingle that one set
only has, so a pair with more bits than a linked pair has such shingles is refused for certain, without reading sets.

Defined results: words are runs of bytes other than 0x20, 0x09-0x0D after lower-casing A-Z; a text of fewer
words than the shingle size is one shingle; a text without words, or null, has an empty set, is linked with
nothing and kept; rows with a null id are kept and have no component but their copies' smallest id; repeated rows
(same id) are all returned, with the same component; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hottest, settle, small_batches, stage, trim, with_ids
from .graph import components
from .wordhash import mix, sequence_keys, shingles, utf8, words

BANDS, BAND_ROWS = 64, 8
SAMPLES = BANDS * BAND_ROWS
SKETCH_WORDS = 32
#: Percent of the union that the intersection must reach.
PERCENT = 80
#: Set sizes from which sketches are asked, and by how many deviations of DEVIATION bits a linked pair may be off.
SURE, DEVIATION, SPREAD = 32, 19, 8
#: Rounds with one hub a row, before what is left is compared in full.
HUB_ROUNDS = 2
#: Rows of a bucket that one task compares with what is left in it.
BLOCK = 1024
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Occupied bins up to which an empty bin looks at all of them, rather than look through its order.
_FEW = 22


@dataclass(frozen=True)
class Scheme:
    """How sets are sampled: of() gives the bucket keys and the SKETCH_WORDS sketch words of each set that isn't empty;
    linked pairs of sets of `sure` or more differ in `bound(percent)` sketch bits at most."""

    of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    bound: Callable[[int], int]
    sure: int


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks at bins, and place * SAMPLES + bin for each (bin looked at, bin)."""
    order = np.argsort(mix(np.arange(SAMPLES * SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(SAMPLES, SAMPLES), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    return order, (place.T * SAMPLES + np.arange(SAMPLES)[:, None]).astype(np.uint32)


_ORDER, _PLACES = _orders()


def samples(made: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One-permutation MinHash samples, a row of SAMPLES for each text that has shingles."""
    many = np.diff(index)
    text = np.repeat(np.cumsum(many > 0) - 1, many)
    rows = int((many > 0).sum())
    out = np.full(rows * SAMPLES, _EMPTY, np.uint64)
    h = mix(made + np.uint64(0x632BE59BD9B4E019))
    bins = text * SAMPLES + (h >> np.uint64(55)).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    place, first = np.unique(bins[order], return_index=True)
    if len(first):
        out[place] = np.minimum.reduceat((h & np.uint64((1 << 55) - 1))[order], first)
    out = out.reshape(rows, SAMPLES)
    full, occupied = out.copy(), np.bincount(place // SAMPLES, minlength=rows)
    few = np.flatnonzero(occupied <= _FEW)
    for at in range(0, len(few), 64):
        some = few[at : at + 64]
        here = np.concatenate([np.flatnonzero(full[r] != _EMPTY) for r in some])
        nearest = np.minimum.reduceat(_PLACES[here], np.cumsum(occupied[some]) - occupied[some], axis=0) % SAMPLES
        out[some] = np.where(full[some] == _EMPTY, full[some[:, None], nearest], full[some])
    row, col = np.nonzero(out == _EMPTY)
    turn = 0
    while len(row):
        got = full[row, _ORDER[col, turn]]
        hit = got != _EMPTY
        out[row[hit], col[hit]] = got[hit]
        row, col = row[~hit], col[~hit]
        turn += 1
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """The 64-bit bucket keys of each row, one for each band."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sampled), BANDS))
    parts = sampled.reshape(len(sampled), BANDS, BAND_ROWS)
    for k in range(BAND_ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.view(np.int64)


def parities(bit: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """SKETCH_WORDS words for each of n rows: whether a bit is toggled an odd number of times in its row."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount(bit.astype(np.int64) + row * bits, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<i8")


def sketches(sampled: np.ndarray) -> np.ndarray:
    """The odd sketch of each row of samples."""
    at = mix(sampled ^ mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(0x3C79AC492BA7B653))) % np.uint64(64 * SKETCH_WORDS)
    return parities(at.ravel(), np.repeat(np.arange(len(sampled)), SAMPLES), len(sampled))


def _odd_bound(percent: int) -> int:
    """The largest XOR population count of a linked pair: the expected one at the threshold, and SPREAD deviations."""
    bits = 64 * SKETCH_WORDS
    return int(bits / 2 * (1 - np.exp(-4 * SAMPLES * (1 - percent / 100) / bits))) + SPREAD * DEVIATION


def _odd(made: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sampled = samples(made, cuts)
    return bands(sampled), sketches(sampled)


ODD = Scheme(_odd, _odd_bound, SURE)

_FEATURES = "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, sketch array<long>"


def _features(size: int, scheme: Scheme):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                data, bounds = utf8(part.column(1))
                h, index = words(data, bounds)
                k1, k2 = sequence_keys(h, index)
                made, cuts = shingles(h, index, size)
                n = np.array([len(np.unique(made[a:z])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], np.int64)
                keys, sketch = scheme.of(made, cuts)
                has = n > 0
                ends = np.concatenate([[0], np.cumsum(has)])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(k1, mask=~has), pa.array(k2, mask=~has), pa.array(n), lists(keys), lists(sketch)], ["doc_id", "k1", "k2", "n_shingles", "bands", "sketch"]
                )
        trim()

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            data, bounds = utf8(b.column(1))
            made, cuts = shingles(*words(data, bounds), size)
            each = [np.unique(made[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            items = np.concatenate(each) if each else np.zeros(0, np.uint64)
            whole = parities(mix(items + np.uint64(0x94D049BB133111EB)) % np.uint64(64 * SKETCH_WORDS), np.repeat(np.arange(len(each)), np.diff(ends)), len(each))
            lists = lambda x, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(items, ends), lists(whole, np.arange(len(each) + 1) * SKETCH_WORDS)], ["id", "items", "whole"])
        trim()

    return run


def _words(sketch: str, prefix: str) -> list[Column]:
    """A sketch as columns, which Spark compiles to far less code than an array's elements."""
    return [F.coalesce(F.col(sketch)[i], F.lit(0)).alias(f"{prefix}{i}") for i in range(SKETCH_WORDS)]


def _unlike(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches, which are columns with these prefixes."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))


def _alike(percent: int, scheme: Scheme, n: tuple[str, str], sketch: tuple[str, str]) -> Column:
    """Sizes and sketches allow a link."""
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & ((F.least(*n) < scheme.sure) | (_unlike(*sketch) <= scheme.bound(percent)))


def _met(pairs: DataFrame, hot: DataFrame, side: str, other: str, table: DataFrame) -> DataFrame:
    """pairs with what table has for the id in `side`; what hot ids have is doubled, so that their pairs are dealt to several tasks."""
    dealt = table.join(F.broadcast(hot), F.col("id") == F.col("hot"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    pairs = pairs.join(F.broadcast(hot), F.col(side) == F.col("hot"), "left").withColumn("part_", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int"))
    return pairs.drop("hot", "parts").join(dealt.drop("hot", "parts"), (F.col(side) == F.col("id")) & (F.col("part_") == F.col("part"))).drop("id", "part", "part_")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, scheme: Scheme = ODD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    settle(spark)  # a model fitted before is in nobody's hands any more
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stage(texts.mapInArrow(_features(size, scheme), _FEATURES), "near-features")
    copies = stage(every.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "near-copies")
    reps = copies.filter("rep is not null").select(F.col("rep").alias("id"), "n")

    whole = copies.filter("rep is not null").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
    firsts = every.join(whole, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    repeated = every.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        firsts = firsts.dropDuplicates(["doc_id", "k1", "k2"])
    exploded = firsts.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    exploded = stage(exploded, "near-bands")
    shared = exploded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").withColumnRenamed("key", "k")
    members = stage(exploded.join(shared, F.col("key") == F.col("k")).select("key", "id", "c"), "near-members")
    # large buckets are dealt to several tasks
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")

    # how many rows an id meets in its buckets, and these buckets
    ids = stage(members.groupBy("id").agg(F.sum("c").alias("central"), F.collect_set("key").alias("keys")), "near-ids")
    light = stage(every.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch").filter("size(sketch) > 0").join(ids.select("id", "keys"), "id").dropDuplicates(["id", "n", "sketch"]), "near-sketches")
    sets = with_ids(texts, "doc_id", ids.select("id")).mapInArrow(_sets(size), "id long, items array<long>, whole array<long>")
    sets = stage(sets.dropDuplicates(["id", "items"]) if repeated else sets, "near-sets")  # whole goes with items

    def linked(pairs: DataFrame, star: bool) -> DataFrame:
        """Pairs (u, v) that are linked: by sizes and sketches (where that isn't known), and by full sets. In stars only v is in many pairs."""
        pairs = stage(pairs, "near-pairs")
        n = pairs.count()

        def met(pairs: DataFrame, side: str, table: DataFrame) -> DataFrame:
            if star and side == "u":
                return pairs.join(table, F.col("u") == F.col("id")).drop("id")
            return _met(pairs, hottest(pairs, side, n), side, "v" if side == "u" else "u", table)

        if star:
            for side in ("u", "v"):
                pairs = met(pairs, side, light.select("id", F.col("n").alias(f"n_{side}"), *_words("sketch", f"s_{side}")))
            pairs = stage(pairs.filter(_alike(percent, scheme, ("n_u", "n_v"), ("s_u", "s_v"))).select("u", "v").distinct(), "near-pairs")
        for side in ("u", "v"):
            pairs = met(pairs, side, sets.select("id", F.col("items").alias(f"i_{side}")))
        common = F.size(F.array_intersect("i_u", "i_v"))
        return pairs.filter(100 * common >= percent * (F.size("i_u") + F.size("i_v") - common)).select("u", "v")

    nodes = reps.select("id").distinct() if repeated else reps.select("id")
    labels = nodes.select("id", F.col("id").alias("component"))
    links = None
    for turn in range(HUB_ROUNDS + 1):
        settle(spark)
        # every member with its component; buckets of one component have nothing more to tell
        known = members.join(labels, "id") if links is not None else members.withColumn("component", F.col("id"))
        if turn < HUB_ROUNDS:
            if turn == 0:
                known = known.join(ids.select("id", "central"), "id").withColumn("rank", F.struct("central", "id"))
            else:
                known = known.withColumn("rank", F.struct(F.xxhash64(F.lit(turn), "id"), "id"))
            tops = known.groupBy("key", "c").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("rank").alias("top"), F.max_by("component", "rank").alias("of")).filter("lo <> hi")
            tops = tops.select(F.col("key").alias("k"), "top", "of", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
            rest = known.withColumn("part", part).join(tops, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))).filter("component <> of")
            chosen = rest.groupBy("id").agg(F.max("top").alias("top")).select("id", F.col("top.id").alias("hub"))
            pairs = chosen.select(F.col("id").alias("u"), F.col("hub").alias("v"))
        else:
            mixed = known.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("c_all")).filter("parts > 1")
            mixed = mixed.select(F.col("key").alias("k"), F.col("m.component").alias("largest"), F.ceil(F.col("c_all") / BLOCK).cast("int").alias("blocks"))
            open_ = stage(known.join(mixed, F.col("key") == F.col("k")).select("key", "id", "component", "largest", "blocks").join(light, "id").join(sets.select("id", "whole"), "id"), "near-open")
            left = open_.filter("component <> largest").select(F.col("key").alias("k_l"), F.col("id").alias("l"), F.col("component").alias("c_l"), F.col("n").alias("n_l"), *_words("whole", "w_l"), *_words("sketch", "s_l"), F.col("keys").alias("keys_l"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b_l"))
            rows = open_.select("key", "id", "component", "largest", "n", "keys", *_words("whole", "w_"), *_words("sketch", "s_"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
            # two rows outside the largest component meet twice; a pair of several common buckets counts in the least
            on = (F.col("key") == F.col("k_l")) & (F.col("block") == F.col("b_l")) & (F.col("component") != F.col("c_l")) & ((F.col("component") == F.col("largest")) | (F.col("id") < F.col("l")))
            once = F.col("key") == F.array_min(F.array_intersect("keys", "keys_l"))
            near = (100 + percent) * _unlike("w_", "w_l") <= (100 - percent) * (F.col("n") + F.col("n_l"))
            pairs = rows.join(left, on & near & _alike(percent, scheme, ("n", "n_l"), ("s_", "s_l")) & once).select(F.col("l").alias("u"), F.col("id").alias("v"))
        found = stage(linked(pairs, star=turn < HUB_ROUNDS), "near-links")
        links = found if links is None else links.union(found)
        grouped = stage(components(links), "near-components")
        labels = nodes.join(grouped, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    named = copies.join(labels, F.col("rep") == F.col("id"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "k1", "k2", "n_shingles").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)


def near_sql(docs: str, size: int) -> str:
    """CTEs up to near_(doc_id, n_shingles, component_id), by all shared shingles of all documents."""
    gram = "list_aggregate(w[i:i + {0}], 'string_agg', ' ')".format(size - 1)
    return f"""
words_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
grams_ AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: {gram}) END) AS g FROM words_)),
sizes_ AS (SELECT doc_id, count(*) AS n FROM grams_ GROUP BY doc_id),
common_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams_ a JOIN grams_ b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links_ AS (SELECT u, v FROM common_ JOIN sizes_ a ON a.doc_id = u JOIN sizes_ b ON b.doc_id = v WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
both_ AS (SELECT u, v FROM links_ UNION ALL SELECT v, u FROM links_),
reach_ AS (SELECT doc_id AS a, doc_id AS b FROM {docs} UNION SELECT r.a, l.v FROM reach_ r JOIN both_ l ON l.u = r.b),
near_ AS (SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM {docs} d JOIN reach_ r ON r.a = d.doc_id LEFT JOIN sizes_ s ON s.doc_id = d.doc_id GROUP BY d.doc_id)
"""


OP3_SQL = f"WITH RECURSIVE {near_sql('documents', 4)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near_"
