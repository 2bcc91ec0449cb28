"""The training-data operators against brute force, libraries and hand-made cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.llm import bpe, chat, counts, fingerprints, graph, licenses, media, mixing, neardup, pretok, ranges, tokenstore, toxicity, wordhash
from wakeline.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "one", "one", "a b c", "\n\t", "é" * 30, "x" * 5000, "word " * 4000, "<|endoftext|> it's <|startoftext|>", "日本語 テキスト", "a\x00b", "DON'T  stop!!!\r\n\r\n ", "٣ ½ ² 😀'll"]


def docs_of(spark, texts, ids=None, source=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if source is None else source[i], -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, words=60, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, words))) for _ in range(n)]


def clashing(df):
    """More columns, named like what operators make."""
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "size", "score", "component_id", "k1", "draw", "bin", "repeats", "target", "ids", "media", "_text", "u", "v", "n")})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def values(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    assert values(got.select(columns).collect()) == values(want.project(", ".join(columns)).fetchall())


def test_ten_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 11)), "similar"}
    assert "pipeline" in entry.queries()


# 1 mixing
def brute_targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        left = over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"B": 10, "a": 0, "é": 300, "z": 1, "zz": 2}, {None: 4}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_mix(spark):
    texts = prose(1, 400) + ODD
    source = ["hot"] * 300 + [("a", "b", None)[i % 3] for i in range(len(texts) - 300)]
    df = docs_of(spark, texts, source=source)
    got = mixing.mix(df).collect()
    assert len(got) == len(texts) and {r.doc_id: r.size for r in got} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    by = {}
    for r in got:
        assert r.taken == r.repeats * r.size <= 3 * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    for target, taken, _ in by.values():
        assert abs(taken - target) <= 4000 / 2 + 1  # half of the longest row
    again = mixing.mix(clashing(df.drop("size", "source_size", "draw", "bin", "target")).repartition(7)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.union(df)).count() == 2 * len(texts)


# 2 token store
def test_perfect_hash():
    keys = np.unique(wordhash.mix(np.arange(5000, dtype=np.uint64)))
    h = tokenstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert tokenstore.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_token_store(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ODD + prose(2, 300) + ["Hello, World. " * 3, "İstanbul Σίσυφος é"]
    ids = [7 * i - 100 for i in range(len(texts))]
    df = clashing(docs_of(spark, texts, ids).drop("ids"))
    store = tokenstore.TokenStore.open(tokenstore.TokenStore.write(df, path).folder)
    got = store.lookup(df.select("doc_id"), payload=True).orderBy("start").collect()
    lib, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in got] == ids
    for r, t in zip(got, texts, strict=True):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.ids, r.start, r.n_tokens, r.ids_crc32) == (want, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    strange = spark.createDataFrame([(10**15 + i,) for i in range(50)], "doc_id long")
    assert store.lookup(strange).count() == 0


def test_token_store_repeats_null_and_empty(spark):
    path = P.path("word_bpe_49k.json")
    df = docs_of(spark, ["b", "a", "a", "zzz", None], [5, 5, 5, None, 1])
    got = tokenstore.TokenStore.write(df, path).lookup(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5] and [r.start for r in got] == [0, got[0].n_tokens, got[0].n_tokens + 1, got[0].n_tokens + 3, got[0].n_tokens + 5]
    none = tokenstore.TokenStore.write(df.limit(0), path)
    # a key of many rows lies in several shards
    n = 3000
    hot = docs_of(spark, [f"text {i % 50} t{i % 7}" for i in range(n)], [None if i % 3 == 0 else 9 if i % 3 == 1 else i for i in range(n)])
    store = tokenstore.TokenStore.write(hot, path)
    rows = store.lookup(hot).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert len(rows) == n and ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(set(store.bounds)) < len(store.bounds)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    whole = {r.start: (r.n_tokens, r.ids_crc32) for r in rows}
    assert {r.start: (r.n_tokens, r.ids_crc32) for r in store.lookup(hot.filter("doc_id is null or doc_id = 9").limit(1)).collect()}.items() <= whole.items()
    assert none.lookup(df).count() == 0 and none.lookup(df.limit(0)).count() == 0


# 3 near duplicates
def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return [len(s) for s in sets], root


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(6)]
    texts = ODD + base + [edited(b, rng.choice([1, 2, 3, 4, 5, 6]), rng) for b in base for _ in range(25)]
    texts += [base[0].upper(), base[0], "a b c d e f", "a b c d e", "a b c d e f g", "A  B\tc"] + prose(3, 40) + [edited(edited(base[1], 3, rng), k, rng) for k in range(12)]
    df = clashing(docs_of(spark, texts).drop("component_id", "id", "k1", "key"))
    got = {r.doc_id: r for r in neardup.near_duplicates(df, size=size).collect()}
    n, root = brute_components(texts, size)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_near_duplicates_odd_tables(spark):
    df = docs_of(spark, ["a b c d e", "a b c d e", "", None, "a b c d e", "q r s t u"], [3, 3, 4, 5, None, None])
    got = sorted(neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect(), key=str)
    assert len(got) == 6 and sum(r.component_id == 3 for r in got) == 3
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    many = docs_of(spark, ["k l m n o p q"] * 300 + ["k l m n o p x"] * 300)
    assert neardup.near_duplicates(many).filter("kept").count() == 2


def at_threshold(rng, n, pairs):
    """Sets of shingle hashes, two and two at 80 % or a little more of a union of n."""
    sets = []
    for i in range(pairs):
        union = rng.integers(0, 2**63, n).astype(np.uint64)
        common = -(-4 * n // 5)
        x = (n - common) // 2 if i % 2 else 0
        sets += [union[: common + x], np.concatenate([union[:common], union[common + x :]])]
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


@pytest.mark.parametrize("scheme", [neardup.ODD, fingerprints.BANDED])
def test_no_link_is_refused_before_the_exact_check(scheme):
    rng = np.random.default_rng(0)
    for n, pairs in [(5, 20_000), (7, 3000), (10, 3000), (31, 1000), (40, 1000), (125, 400), (600, 100), (2500, 30)]:
        for at in range(0, pairs, 500):
            made, cuts = at_threshold(rng, n, min(500, pairs - at))
            keys, sketch = scheme.of(made, cuts)
            assert (keys[::2] == keys[1::2]).any(axis=1).all()
            off = np.bitwise_count(sketch[::2].view(np.uint64) ^ sketch[1::2].view(np.uint64)).sum(axis=1)
            least = np.minimum(np.diff(cuts)[::2], np.diff(cuts)[1::2])
            assert ((off <= scheme.bound(80)) | (least < scheme.sure)).all()


def test_links_of_small_sets(spark):
    rng = random.Random(8)
    pairs = [("t3707 t1133 t4161 t2727 t577 t117 t891",) * 2]
    pairs += [(" ".join(f"t{rng.randrange(5000)}" for _ in range(7 + i % 3)),) * 2 for i in range(1500)]
    texts = [t for a, b in pairs for t in (a, f"{b} t{rng.randrange(5000)}")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), size=4).collect()}
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_parities_count_differing_shingles_at_most():
    """An XOR of odd sketches of whole sets never has more bits than the sets have shingles apart."""
    rng = np.random.default_rng(2)
    for n, off in [(1, 0), (30, 5), (400, 90), (5000, 1200)]:
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[off:], rng.integers(0, 2**63, off).astype(np.uint64)])
        x, y = (neardup.parities(wordhash.mix(v) % np.uint64(2048), np.zeros(n, np.int64), 1).view(np.uint64) for v in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= 2 * off


def test_samples_fill_empty_bins_alike():
    """Few or many occupied bins: the first occupied one in a bin's order gives its sample."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 21, 22, 23, 24, 60, 900):
        made = rng.integers(0, 2**63, n).astype(np.uint64)
        got = neardup.samples(made, np.array([0, n]))[0]
        h = wordhash.mix(made + np.uint64(0x632BE59BD9B4E019))
        least = {}
        for x in h.tolist():
            least[x >> 55] = min(least.get(x >> 55, x & (1 << 55) - 1), x & (1 << 55) - 1)
        for col in range(neardup.SAMPLES):
            where = col if col in least else next(b for b in neardup._ORDER[col].tolist() if b in least)
            assert got[col] == least[where]


def test_sketch_tells_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.72, 0.8, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        keep = int(round(2000 * 2 * j / (1 + j)))
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, 2000 - keep).astype(np.uint64)])
        s = neardup.sketches(neardup.samples(np.concatenate([a, b]), np.array([0, 2000, 4000]))).view(np.uint64)
        count = int(np.bitwise_count(s[0] ^ s[1]).sum())
        bits = 64 * neardup.SKETCH_WORDS
        assert 1 + bits / (4 * neardup.SAMPLES) * np.log(1 - 2 * count / bits) == pytest.approx(j, abs=0.09)
        assert count <= neardup.ODD.bound(80) or j < 0.6


def test_shared_passages_and_hubs_in_blocks(spark, monkeypatch):
    """Large buckets, dealt to several tasks: one hub's copies, and texts that share most words but aren't linked."""
    from wakeline.llm import common

    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(9000)}" for _ in range(90))
    texts = [f"{passage} " + " ".join(f"q{rng.randrange(9000)}" for _ in range(18 + i % 9)) for i in range(60)]
    hub = " ".join(f"h{rng.randrange(9000)}" for _ in range(200))
    texts += [edited(hub, i % 5, rng) for i in range(60)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), size=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4)[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in (100, 101, 102, 200))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4 byte-level BPE and 9 counts
def fuzz(n=3000):
    rng = random.Random(4)
    parts = ["a", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "é", "!", "-", " ", "日本", "　", "'ve", "d", "😀", "́", "٣", "<|endoftext|>", "the", "\x85", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)] + ["a" * 1500, "-" * 700 + "x" * 400, " " * 300 + "z", "''s", " 's"]


def test_bpe_equals_tiktoken():
    import tiktoken

    table = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    texts = fuzz() + [x for x in ODD if x] + prose(6, 50)
    for t, (ids, lengths, offsets) in zip(texts, table.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert table.decode(ids) == t.encode() and len(lengths) == len(offsets)
    assert table.merge(b"ab" * 300) == lib.encode_ordinary("ab" * 300)


def test_pieces_equal_the_pattern_for_any_block():
    import regex

    texts = fuzz(400)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    at = np.cumsum([0, *map(len, texts)])
    first[at[:-1][np.diff(at) > 0]] = True
    want = [a + m.start() for t, a in zip(texts, at, strict=False) for m in regex.finditer(P.PATTERN, t)]
    for block in (1, 3, 64, 4096):
        assert pretok.piece_starts(points, first, block).tolist() == want


def test_bpe_frames(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = clashing(docs_of(spark, ODD + ODD).drop("ids"))
    made = bpe.encode(df, path)
    assert sorted(r.decoded or b"" for r in bpe.decode(made, path).collect()) == sorted((t or "").encode() for t in ODD + ODD)
    r = {x.doc_id: x for x in bpe.round_trip(df, path).collect()}
    for i, t in enumerate(ODD):
        assert r[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    part = made.filter("doc_id = 13").head()
    ids, words = np.frombuffer(part.ids, "<u4"), bpe.ranks(path)
    assert words.decode(ids[part.piece_ids[1] : part.piece_ids[2]].tobytes()) == ODD[13].encode()[part.piece_bytes[1] : part.piece_bytes[2]]
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_counts_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), fuzz() + [x or "" for x in ODD] + prose(6, 50)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counts.counter(path).count(texts).tolist() == want
    monkeypatch.setattr(counts, "MAX_STATES", 200)  # the table starts anew again and again
    fresh = counts.Counter(path)
    assert fresh.count(texts).tolist() == want
    monkeypatch.setattr(counts, "MAX_STATES", 60_000)
    rng = random.Random(7)
    long = ["".join(rng.choice("abcdeot") for _ in range(20_000)), "a" * 12_345, "the" * 5000, "é" * 6000, "ab" * 3000 + "c", "-" * 9999, "x" * 4097, " ".join("z" * k for k in (4096, 4097, 8192, 1))]
    sizes = [len(lib.encode(t, add_special_tokens=False).ids) for t in long]
    assert counts.Counter(path).count(long).tolist() == sizes
    for step, warm in ((7, 0), (64, 3), (1000, 16)):  # guesses that are wrong are asked for again
        monkeypatch.setattr(counts, "STEP", step)
        monkeypatch.setattr(counts, "WARM", warm)
        assert counts.Counter(path).count(long[1:]).tolist() == sizes[1:]
    df = clashing(docs_of(spark, ODD).drop("n"))
    got = {r.doc_id: r for r in counts.token_counts(df, path).collect()}
    for i, t in enumerate(ODD):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert counts.token_counts(df.limit(0), path).count() == 0


# 5 chat
def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "ho"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
            (5, 0, "user", "hi"), (5, 1, "assistant", "ho"), (5, 2, "user", "bye"), (6, 0, "user", None), (7, 0, "user", ""), (8, None, None, "x"), (8, None, None, "x"), (None, 0, "user", "lost"), (9, 1, "b", "y"), (9, 0, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("place", "h0", "copies", "n_turns", "turns")})
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert sorted(got) == [3, 4, 6, 7, 8, 9] and got[3].copies == 2 and got[8].n_turns == 2
    assert got[4].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert got[9].text.startswith("<|im_start|>a\nx") and got[6].text == got[7].text
    assert chat.render(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_chat", "op8_licenses"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# 6 fingerprints
def test_fingerprints(spark):
    texts = [x for x in ODD] + prose(8, 120, 300) + ["same text here"] * 3
    df = clashing(docs_of(spark, texts, [3 * i + 1 for i in range(len(texts))]))
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(df).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        r, following = got[3 * i + 1], plain[i - 1] if i else plain[-1]
        k = len(t) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (r.fingerprint == got[3 * (i - 1 if i else len(texts) - 1) + 1].fingerprint)
    assert len({got[3 * i + 1].fingerprint for i in range(len(texts) - 3, len(texts))}) == 1
    long = [r for r in got.values() if r.n_chars > 200 and r.n_chars < 3000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    alone = fingerprints.fingerprint(df).collect()
    assert all(r.fingerprint == got[r.doc_id].fingerprint for r in alone)


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    b = a[:480] + [f"w{rng.randrange(10**6)}" for _ in range(120)]
    s = fingerprints.signatures_of(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
    true = 476 / (2 * 596 - 476)
    assert fingerprints.likeness(s[:1], s[1:])[0] == pytest.approx(true, abs=0.15)


def test_likeness_goes_on_through_all_lengths():
    rng = random.Random(3)
    all_words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    of = lambda *texts: fingerprints.signatures_of(pa.array(texts, pa.large_string()))
    for n, less in [(40, 1), (42, 3), (41, 4), (60, 3), (30, 1), (20, 1)]:
        s = of(" ".join(all_words[:n]), " ".join(all_words[: n - less]))
        assert fingerprints.likeness(s[:1], s[1:])[0] == pytest.approx((n - less - 4) / (n - 4), abs=0.12)
    short = of("the quick brown fox jumped over it", "the quick brown dog jumped over it", "nothing like this at all", "abc", "abd", "ab", "", " ")
    assert fingerprints.likeness(short[:1], short[1:2])[0] > 0.1 and fingerprints.likeness(short[:1], short[2:3])[0] == 0
    assert all((short[i] != short[j]).all() for i in range(3, 7) for j in range(3, i)) and (short[6] == short[7]).all()
    every = [" ".join(all_words[:k]) for k in range(60)] * 8
    assert (of(*every) == np.concatenate([of(x) for x in every])).all()


def test_fingerprints_odd_tables(spark):
    one = fingerprints.edit_fingerprints(docs_of(spark, ["abc def"], [9])).head()
    assert one.near_next == 1 and one.n_chars == 7
    assert fingerprints.edit_fingerprints(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert fingerprints.edit_fingerprints(docs_of(spark, ["x y", "x y", "z"], [1, 1, None])).count() == 3
    assert fingerprints.edit_fingerprints(docs_of(spark, ["x y", "z"], [None, None])).count() == 2
    rng = random.Random(9)
    texts = [edited(" ".join(f"w{rng.randrange(900)}" for _ in range(120)), 0, rng)] + prose(4, 20)
    texts += [edited(texts[0], k % 5, rng) for k in range(20)]
    groups = {r.doc_id: r.component_id for r in fingerprints.similar_groups(docs_of(spark, texts)).collect()}
    assert [groups[i] for i in range(len(texts))] == brute_components(texts, 5)[1]


def test_ranges_hold_all_keys():
    keys = pa.array([None, -5, 0, 7, 10**12], pa.int64())
    assert ranges.range_of(keys, np.array([0, 8])).tolist() == [0, 0, 1, 1, 2]
    bounds = np.array([-(1 << 63), -(1 << 63), 7, 7, 7, 9])
    first, many = ranges.ranges_of(keys, bounds)
    assert list(zip(first.tolist(), many.tolist(), strict=True)) == [(1, 2), (2, 1), (2, 1), (3, 3), (6, 1)]
    assert ranges.range_of(keys, bounds, np.array([0, 5, 5, 1, 5])).tolist() == [1, 2, 2, 4, 6]


# 7 media
def test_media(spark):
    df = clashing(docs_of(spark, ODD + ODD[::-1]).drop("media"))
    got = {r.doc_id: r for r in media.MediaStore.write(media.store(df)).read().collect()}
    feature = {}
    for i, t in enumerate(ODD + ODD[::-1]):
        raw = (t or "").encode()
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert feature.setdefault(raw, r.feature) == r.feature
    assert media.MediaStore.write(media.store(df.limit(0))).read().count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(12_000) / media.RATE
    y = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 8000
    spectrum = np.abs(np.fft.rfft(y[1000:7000]))
    assert np.argmax(spectrum) * media.OUT_RATE / 6000 == pytest.approx(440, abs=2)
    assert np.abs(y[1000:7000]).max() == pytest.approx(1, abs=0.05)
    high = media.resample(np.sin(2 * np.pi * 5500 * t).astype(np.float32))  # beyond the new half rate
    assert np.abs(high[1000:7000]).max() < 0.3


def test_segments_have_hysteresis():
    mel = np.zeros((100, media.MELS), np.float32)
    mel[20:40] = 10
    mel[40:50] = 4  # under the upper threshold, over the lower one
    mel[70:80] = 10
    assert media.segments(mel).tolist() == [[20, 50], [70, 80]]
    assert media.segments(np.zeros((5, media.MELS), np.float32)).tolist() == []


def plain_features(payload):
    """Resampling, log-mel energies, pooling and segments by plain loops, in doubles."""
    x = [(b - 128) / 128 for b in payload]
    n = media.UP * media.TAPS
    h = [np.sinc((i - (n - 1) / 2) / media.DOWN) * w for i, w in enumerate(np.hanning(n + 2)[1:-1])]
    h = [v / sum(h) * media.UP for v in h]
    # zero-stuffed by UP, filtered, every DOWN-th kept
    y = [sum(h[i] * x[(m * media.DOWN - i) // media.UP] for i in range(n) if (m * media.DOWN - i) % media.UP == 0 and 0 <= (m * media.DOWN - i) // media.UP < len(x)) for m in range(len(x) * media.UP // media.DOWN)]
    y += [0.0] * max(0, media.FRAME - len(y))
    window = np.hanning(media.FRAME + 2)[1:-1]
    mel = []
    for at in range(0, len(y) - media.FRAME + 1, media.HOP):
        power = np.abs(np.fft.rfft(np.array(y[at : at + media.FRAME]) * window, media.FFT)) ** 2
        mel.append([np.log(sum(power[f] * media._BANK[f][k] for f in range(len(power))) + 1e-6) for k in range(media.MELS)])
    mel = np.array(mel)
    parts = [k * len(mel) // media.FRAMES for k in range(media.FRAMES + 1)]
    tensor = np.array([mel[a : max(z, a + 1)].mean(axis=0) for a, z in zip(parts[:-1], parts[1:], strict=True)])
    energy, on, spans = mel.mean(axis=1), False, []
    upper, lower = energy.mean() + 0.5 * energy.std(), energy.mean()
    for i, e in enumerate([*energy, -1e9]):
        if not on and e > upper:
            on, begin = True, i
        elif on and e < lower:
            on = False
            spans.append([begin * media.HOP / media.OUT_RATE, i * media.HOP / media.OUT_RATE])
    return tensor, spans


def test_features_equal_a_plain_computation(spark):
    rng = random.Random(12)
    texts = ["", "short one", "".join(chr(rng.randrange(32, 127)) for _ in range(1500)), "aaaa" * 200 + "ZZ z!" * 200, "é😀" * 300]
    store = media.MediaStore.write(media.store(docs_of(spark, texts)))
    got = {r.doc_id: r for r in store.tensors().collect()}
    said = {r.doc_id: r.feature for r in store.read().collect()}
    for i, t in enumerate(texts):
        tensor, spans = plain_features(media.pad(t.encode()))
        assert np.array(got[i].tensor).reshape(media.FRAMES, media.MELS) == pytest.approx(tensor, abs=0.02)
        assert np.array(got[i].spans) == pytest.approx(np.array(spans))
        level, many, total, _ = said[i].split(":")
        assert np.abs(np.frombuffer(bytes.fromhex(level), np.int8) / 8 - np.clip(tensor.mean(axis=0), -16, 127 / 8)).max() < 0.1
        assert int(many) == len(spans) and float(total) == pytest.approx(sum(z - a for a, z in spans), abs=0.006)


def test_tensors_are_stored_once(spark, tmp_path):
    """Files are fixed-shape tensors; those of a doubled task, or of a second run into the folder, are not read twice."""
    df = docs_of(spark, ODD)
    folder = f"file://{tmp_path}/t"
    first = media.MediaStore.write(media.store(df), folder)
    second = media.MediaStore.write(media.store(df), folder)
    names = {r.tensors for r in first.files.collect()}
    assert names and not names & {r.tensors for r in second.files.collect()}
    (tmp_path / "t" / "0000000-left-behind.tensors.arrow").write_bytes(b"half a file")
    for store in (first, second):
        assert sorted(r.doc_id for r in store.read().collect()) == list(range(len(ODD))) and sum(r.rows for r in store.files.collect()) == len(ODD)
    table = pa.ipc.open_file(f"{tmp_path}/t/{sorted(names)[0]}").read_all()
    assert table.schema.field("tensor").type.shape == [media.FRAMES, media.MELS]


# 8 licences
def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-header"]
    filler = "alpha beta gamma delta "
    changed = gpl.split()
    changed[3] = "thing"
    texts = [mit, filler * 50 + mit + " " + filler * 30, filler * 7 + gpl + filler, " ".join(changed), " ".join(gpl.split()[:15]), "license " * 300, "", None, filler * 9, mit + "\n" + gpl, "RELEASED, UNDER the mit... License"]
    df = clashing(docs_of(spark, texts))
    got = {(r.doc_id, r.license): r for r in licenses.scan(df).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT"), (2, "GPL-3.0-header"), (3, "GPL-3.0-header"), (9, "MIT"), (9, "GPL-3.0-header"), (10, "MIT")}
    assert got[1, "MIT"].start_word == 200 and got[2, "GPL-3.0-header"].containment == 1 and 0.8 <= got[3, "GPL-3.0-header"].containment < 1
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, {"short": "two words"})


def test_anchors_lose_nothing():
    for text in licenses.TEMPLATES.values():
        s = licenses.template_shingles(licenses.template_words(text))
        a = set(licenses.anchors(s))
        without = sum(not a & set(x.split()) for x in s)
        assert 100 * without < licenses.PERCENT * len(s)


# 10 toxicity
def brute_nearest(vectors, query, k):
    scored = [(round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)]
    return sorted(((-s, i) for s, i in scored if s > 0))[:k]


def test_block_max_index_is_exact(monkeypatch):
    rng = random.Random(2)

    def vector():
        v = {t: rng.random() + 0.1 for t in rng.sample(range(40), rng.randrange(1, 7))}
        n = sum(x * x for x in v.values()) ** 0.5
        return {t: x / n for t, x in v.items()}

    vectors = [vector() for _ in range(700)] + [{1: 1.0}] * 30
    index = toxicity.BlockMaxIndex(vectors)
    queries = [vector() for _ in range(60)] + [{1: 1.0}, {99: 1.0}, {}]
    want = [[(-s, i) for s, i in brute_nearest(vectors, q, 15)] for q in queries]
    assert index.nearest(queries, 15) == want
    monkeypatch.setattr(toxicity, "ENTRIES", 40)  # a few at a time
    assert index.nearest(queries, 15) == want and index.nearest([], 15) == []


def toxic_table(spark, n=900):
    texts, labels = prose(11, n, 80, 3000), {}
    for i in range(n):
        bad = i % 9 == 0
        labels[i] = int(bad)
        if bad:
            texts[i] += f" you {random.Random(i).choice(['grubling', 'snarfer'])}{random.Random(i + 1).choice(['', 's', 'ish'])} really"
    return docs_of(spark, texts), spark.createDataFrame([(k, v, 1) for k, v in labels.items()] + [(n + 5, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int"), labels


def test_toxicity_on_held_out_rows(spark):
    df, table, labels = toxic_table(spark)
    model = toxicity.fit(df, table)
    got = {r.doc_id: r for r in toxicity.score(clashing(df.drop("score")), model).collect()}
    out = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    hit = [got[i].predicted == labels[i] for i in out]
    assert len(out) > 150 and np.mean(hit) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    learnt = {x for r in got.values() for x in r.evidence}
    assert learnt and not learnt & set(out)  # evidence is never a held-out row
    odd = {r.doc_id: r for r in toxicity.score(docs_of(spark, ODD), model).collect()}
    assert len(odd) == len(ODD) and odd[0].score == odd[1].score and odd[0].predicted == 0
    assert toxicity.score(df.limit(0), model).count() == 0


def test_every_example_is_found_by_its_copy(spark):
    """Also abuse that one example only has, which is no sure mark of label 1."""
    texts = [f"{t} rareword{i}" if i % 9 == 0 else t for i, t in enumerate(prose(12, 200, 60, 3000))]
    model = toxicity.Model(toxicity.described([(i, t, int(i % 9 == 0)) for i, t in enumerate(texts)]), 0.1)
    for i, t in enumerate(texts):
        score, evidence = model.score(t)
        assert evidence[0] == i and (score >= toxicity.THRESHOLD) == (i % 9 == 0)
    n = model.neighbours
    vectors = [dict(zip(*(x.tolist() for x in n.vector(toxicity.counts(texts[i]))), strict=True)) for i in n.ids]
    for t in prose(13, 30, 60, 3000):
        near = brute_nearest(vectors, dict(zip(*(x.tolist() for x in n.vector(toxicity.counts(t))), strict=True)), toxicity.NEIGHBOURS)
        score, evidence = model.score(t)
        assert evidence == [n.ids[row] for _, row in near]
        # votes by cosine at the labels' natural weights, through the map of votes
        share = {0: 0.9 / 177, 1: 0.1 / 23}
        label = lambda row: int(n.ids[row] % 9 == 0)
        vote = sum(-s * share[1] for s, row in near if label(row)) / sum(-s * share[label(row)] for s, row in near)
        assert n.vote(n.nearest([n.tf(toxicity.counts(t))])[0]) == pytest.approx(vote)
        if near[0][0] > -toxicity.SAME:
            assert score == pytest.approx(min(1.0, [y for x, y in zip(model.steps, model.levels, strict=True) if x <= vote + 1e-9][-1]))


def test_vectors_are_tf_idf():
    texts = ["aa bb aa cc", "aa dd", "bb ee ee", "ff aa"]
    model = toxicity.Model(toxicity.described([(i, t, i % 2) for i, t in enumerate(texts)]), 0.5)
    n = model.neighbours
    terms, weights = n.vector(toxicity.counts("aa aa bb zz"))
    raw = {"aa": (1 + np.log(2)) * (np.log(5 / 4) + 1), "bb": np.log(5 / 3) + 1}
    factor = {m: n.scale[n.marks[m]] / (raw[m] / ((1 + np.log(2)) if m == "aa" else 1)) for m in raw}
    raw = {m: v * factor[m] for m, v in raw.items()}
    norm = sum(v * v for v in raw.values()) ** 0.5
    names = {v: k for k, v in n.marks.items()}
    assert {names[t]: w for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if names[t] in raw} == pytest.approx({m: v / norm for m, v in raw.items()}, rel=1e-9)
    assert all(toxicity.PLAIN - 1e-9 <= f <= 1 + 1e-9 for f in factor.values())


def test_calibration_is_monotone_regression():
    rng = np.random.default_rng(4)
    votes = rng.integers(0, 40, 300) / 40
    labels = (rng.random(300) < votes).astype(np.int64)
    weights = np.where(labels, 0.7, 1.3)
    model = toxicity.Model([], 0.0)
    model._calibrate(votes, labels, weights)
    at = np.unique(votes)
    num, den = ([float((w[votes == v]).sum()) for v in at] for w in (weights * labels, weights))
    best = [max(min(sum(num[a : z + 1]) / sum(den[a : z + 1]) for z in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    got = [model.levels[np.searchsorted(model.steps, v, side="right") - 1] for v in at]
    assert (np.diff(model.levels) >= 0).all() and np.abs(np.array(got) - best).max() < 0.2
    assert len({round(x, 9) for x in best}) >= len(set(got))


def test_copies_share_a_vote_when_confirmed():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(9000)}" for _ in range(120))
    passage = " ".join(base.split()[:50])
    texts = [base, edited(base, 1, rng), base, f"{passage} " + " ".join(f"v{rng.randrange(9000)}" for _ in range(90)), "", None, "x"]
    assert toxicity.copy_groups(toxicity.sampled(texts)).tolist() == [0, 0, 0, 3, 4, 5, 6]


def test_long_words_are_whole():
    """Words that agree in their first thousand characters are different words."""
    head = "a" * 1000
    rows = [(i, f"{head}{'x' if i % 2 else 'y'} plain words", i % 2) for i in range(12)]
    model = toxicity.Model(toxicity.described(rows), 0.5)
    assert model.score(head + "x plain words")[0] > 0.3 > model.score(head + "y plain words")[0]


def test_toxicity_without_labels(spark):
    df, table, _ = toxic_table(spark, 30)
    for labels in (table.limit(0), table.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()} == {0.0}


# the pipeline
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    clean = C.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    negatives = [i for i, y in labels.items() if y == 0]
    assert np.mean([i in kept for i in negatives]) > 0.97
    single = C.drop_near_duplicates(spark, clean, sf_dir)
    ids = sorted(kept)
    _, root = brute_components([rows[i].text for i in ids], 5)
    assert sorted(r.doc_id for r in single.collect()) == [ids[k] for k in sorted(set(root))]
    mixed = C.mix_sources(spark, single, sf_dir)
    want = sorted(x for r in mixing.mix(single).collect() for x in [r.doc_id] * r.repeats)
    assert sorted(r.doc_id for r in mixed.collect()) == want and mixed.columns == docs.columns
    assert C.encode(spark, mixed, sf_dir).count() == len(want)
    assert len(C.STAGES) == 4 and C.ORACLE_SQL is None


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_pipeline_near_dedup_on_null_and_repeated_ids(spark, sf_dir):
    """One row of each group, by brute force over rows."""
    import corpus_pipeline as C

    rng = random.Random(21)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(4)]
    texts = [base[0], base[0], base[0], base[1], edited(base[1], 1, rng), base[2], edited(base[2], 1, rng), base[3], "lone text of six words here", "", "", None, None]
    ids = [None, None, None, None, 7, 7, 7, 7, None, None, 8, 8, 8]
    df = clashing(docs_of(spark, texts, ids))
    got = C.drop_near_duplicates(spark, df, sf_dir)
    _, root = brute_components(texts, 5)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    kept = sorted(str((r.doc_id, r.text)) for r in got.collect())
    assert len(kept) == len(groups) and got.columns == df.columns
    want = []
    for r, members in groups.items():
        least = min((ids[i] is None, ids[i] or 0) for i in members)
        want.append([str((ids[i], texts[i])) for i in members if (ids[i] is None, ids[i] or 0) == least])
    for one in want:
        assert sum(k in one for k in set(kept)) >= 1
    assert kept.count(str((None, base[0]))) == 1 and str((None, base[1])) not in kept  # 7 has a near copy
    assert kept.count(str((8, None))) == 2
    more = C.drop_near_duplicates(spark, df.union(docs_and(spark, df, 50)), sf_dir)
    assert sum(r.text == base[0] for r in more.collect()) == 1


def docs_and(spark, like, i):
    """Two rows of one id, of other words."""
    extra = docs_of(spark, ["quite other words are in here", "quite other words are in here"], [i, i])
    return clashing(extra).select(*like.columns)


def test_pipeline_mix_on_null_and_repeated_ids(spark, sf_dir, monkeypatch):
    """What the stage writes is what the mix takes, row by row; rows of one draw are dealt to several tasks."""
    import corpus_pipeline as C

    monkeypatch.setattr(mixing, "EDGE_ROWS", 16)
    texts = prose(30, 200, 60)
    ids = [None] * 90 + [5] * 60 + list(range(100, 150))
    source = [("a", "b", None, "c")[i % 4] for i in range(200)]
    df = clashing(docs_of(spark, texts, ids, source))
    taken = mixing.mix(df)
    plan = {r.source: (r.target, r.source_size) for r in taken.collect()}
    got = C.mix_sources(spark, df, sf_dir)
    assert got.columns == df.columns
    size = lambda t: len(WORD.findall(t or ""))
    each = {(i, t, s): 0 for i, t, s in zip(ids, texts, source, strict=True)}
    for r in got.collect():
        each[r.doc_id, r.text, r.source] += 1
    for s, (target, whole) in plan.items():
        words = sum(n * size(t) for (_, t, z), n in each.items() if z == s)
        assert abs(words - target) <= 30 + 1 and words == sum(r.taken for r in taken.filter(F.col("source").eqNullSafe(F.lit(s))).collect())
        assert {n for (_, t, z), n in each.items() if z == s and t} <= {int(target // whole), int(target // whole) + 1}
    assert rows_of(got) == rows_of(C.mix_sources(spark, df.repartition(5), sf_dir))


def test_pipeline_stages_odd_tables(spark, sf_dir):
    import corpus_pipeline as C

    df = clashing(docs_of(spark, ODD + ["a b c d e f"] * 3, [None, *range(len(ODD) + 2)]))
    for table in (df, df.limit(0), df.union(df)):
        for name, stage in C.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == "byte-bpe" or out.columns == df.columns
            assert (out.count() == 0) == (table.isEmpty())


# 4 and 9: the fast forms against the plain ones
def test_pieces_merged_side_by_side(monkeypatch):
    table = bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(11)
    some = sorted({bytes(rng.choice(b"abcde \xd0\xb0\xff\x00") for _ in range(rng.randint(1, 64))) for _ in range(3000)})
    want = [np.array(table.merge(x), "<u4").tobytes() for x in some]
    assert table.merge_many(some) == want
    assert table.merge_many([b"a"]) == [np.array(table.merge(b"a"), "<u4").tobytes()]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 64)  # generations change with every call
    for at in range(0, len(some), 50):
        assert table.encode_pieces(some[max(0, at - 25) : at + 50]) == want[max(0, at - 25) : at + 50]


def test_tokens_left_apart():
    machine = counts.Counter(P.path("byte_bpe_50k.json")).machine
    rng = random.Random(12)
    known = sorted(machine.text)
    few = [machine.tokens[x] for x in (b"a", b"aa", b"b", b"ab", b"the", b"he", b"t", b" ", b"  ", b"--", b"-") if x in machine.tokens]
    pairs = [(a, b) for a in few for b in few] + [(rng.choice(known), rng.choice(known)) for _ in range(3000)]
    assert all(machine._apart(a, b) == (machine.merge(machine.text[a] + machine.text[b]) == [a, b]) for a, b in pairs)
    with pytest.raises(ValueError, match="out of order"):
        counts.MergeMachine({b"a": 0, b"aa": 1, b"aaa": 2}, {(0, 0): (5, 1), (1, 0): (3, 2)})


def test_pipeline_driver_gives_memory_back(spark, sf_dir, monkeypatch):
    """The C heap of the driver's JVM is trimmed after each staged table, and the model is gone before rows are scored."""
    import weakref

    import corpus_pipeline as C
    from wakeline.llm import common

    assert "native heap" in common.trim_jvm(spark)
    trims, models, alive = [], [], []
    fit, trim = toxicity.fit, common.trim_jvm
    monkeypatch.setattr(common, "trim_jvm", lambda s: trims.append(1) or trim(s))
    common.stage(spark.range(3), "trimmed")
    assert trims

    def fitted(*args):
        model = fit(*args)
        models.append(weakref.ref(model))
        return model

    monkeypatch.setattr(toxicity, "fit", fitted)
    monkeypatch.setattr(C, "settle", lambda s: alive.append(models[0]() is not None))
    C.drop_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert alive == [False]
