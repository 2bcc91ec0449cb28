"""Token-id output: shards of raw ids with a minimal perfect hash index for keyed access.

write() encodes whole texts, deals them by ranges of the document key, and each task writes one shard file:
all id payloads in ascending key order, row offsets, then an index. The index is a minimal perfect hash
(levels of bit arrays; a key's slot is the rank of its bit), and each slot holds a stored fingerprint of its
key with the first row and the number of rows of that key. A lookup costs a few hash probes, however many
keys a shard has; a foreign key is refused by its fingerprint, but for one in 2**32. Rows of a null key lie first and are
found by their number. A key of very many rows lies in several shards, by its ids.

There are ranges.MOST_RANGES shards at most, so from about a thousand million rows on shards grow with the table; a
task holds some 50 bytes a row of its shard, and reads and writes payloads piece by piece.

lookup() loads a shard's index once, finds rows by key through it, and reads the payloads of runs of adjacent rows.

Files are written under a name of the task's own and then renamed, so a retried or doubled task does no harm.

Defined results: null text is empty (only the end id); a null key sorts first and is a key like others;
repeated keys keep all their rows; an empty table makes a store without shards; other columns
of the input are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, merged, new_path, small_batches
from .ranges import range_bounds, range_of, ranges_of, runs
from .wordhash import mix

END_ID = 1
#: Rows of a shard: few for small tables, to keep all cores busy; files of some 100 MB for large ones.
LEAST_ROWS, MOST_ROWS = 512, 65_536
#: Rows whose new words are learnt together, and words that a worker remembers.
ROWS = 2000
CACHE_WORDS = 800_000
MAGIC, FOOTER = b"WKTS0002", struct.Struct("<QQQQQQQQQ8s")
#: Bytes of payload that are read at once, where one row has no more.
READ_BYTES = 4 << 20
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """The tokenizers library with a memory of words.

    Its normaliser and splitter never join characters across ASCII white space, so the ids of a text are
    those of its ASCII-separated words, one after the other. New words go to the library many at a time: words of
    letters alone are one piece each, so they share a call and are told apart by the ids that end a piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        end = file["model"].get("end_of_word_suffix")
        lower = any(x["type"] == "Lowercase" for x in (file["normalizer"] or {}).get("normalizers", [file["normalizer"] or {"type": ""}]))
        if not end or not lower:
            raise ValueError(f"{path} has no ends of words, or keeps the case")
        self.ends = np.zeros(max(file["model"]["vocab"].values()) + 1, bool)
        self.ends[[v for k, v in file["model"]["vocab"].items() if k.endswith(end)]] = True
        self.special = [x["content"].encode() for x in file["added_tokens"]]
        self.known: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            for word, made in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.known[word] = np.array(made.ids, self.dtype).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                self._whole(some)
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            stops = (cuts * width).tolist()
            for word, a, b in zip(some, [0, *stops], stops, strict=False):
                self.known[word] = raw[a:b]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        # a stop or comma after an ASCII letter is a piece of its own
        tail = {w: w[:-1] for w in new if w[-1] in b",.;:!?|" and len(w) > 1 and 97 <= w[-2] <= 122}
        todo = new.difference(tail)
        todo.update(w for w in tail.values() if w not in known)
        todo.update(w for w in (bytes([c]) for c in b",.;:!?|") if tail and w not in known)
        letters, other = [], []
        for w in todo:
            text = w.decode()
            (letters if text.isalpha() and text.lower().isalpha() else other).append(w)
        self._letters(letters)
        self._whole(other)
        for w, base in tail.items():
            known[w] = known[base] + known[w[-1:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        raw = [x.encode() if x else b"" for x in texts]
        # special strings keep their case; all else is lower-cased by the library anyway
        split = [(x if any(s[:2] in x for s in self.special) else x.lower()).split() for x in raw]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set().union(*split)
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def key_hash(keys: pa.Array) -> np.ndarray:
    """A one-to-one map of keys that aren't null to 64-bit numbers."""
    ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(mix(ids + np.uint64(0x9E3779B97F4A7C15)))


def is_null(keys: pa.Array) -> np.ndarray:
    return keys.is_null().to_numpy(zero_copy_only=False)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit key hashes."""

    GAMMA, LEVELS = 2, 48

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, levels = hashes, [], []
        while len(left):
            if len(sizes) == cls.LEVELS:
                raise ValueError("keys of a shard are not distinct")
            size = max(64, cls.GAMMA * len(left))
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            words = np.zeros((size + 63) // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] // 64, np.uint64(1) << (at[alone] % 64).astype(np.uint64))
            sizes.append(size)
            levels.append(words)
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((0xD1B54A32D192ED03 * (level + 1)) & ((1 << 64) - 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has its bit (surely a foreign key)."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self._at(hashes[left], level, int(size))
            word, bit = self.base[level] + at // 64, (at % 64).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.rank[word] + below)[here]
            left = left[~here]
        return out


def _write_shard(folder: str, shard: int, rows) -> tuple[int, int]:
    """rows: (keys, list of id bytes, bytes of an id) batches in key order, nulls first. Returns the numbers of rows and ids."""
    fs, root = pafs.FileSystem.from_uri(folder)
    tmp = f"{root}/.{shard:07d}-{uuid.uuid4().hex}"
    hashes, lengths, width, nulls = [np.zeros(0, np.uint64)], [], 0, 0
    with fs.open_output_stream(tmp) as out:
        for x, ids, width in rows:
            nulls += x.null_count
            hashes.append(key_hash(x)[~is_null(x)])
            lengths.append(np.array([len(i) for i in ids], np.int64) // width)
            out.write(b"".join(ids))
        h, offsets = np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        keys = h[first]
        found = PerfectHash.build(keys)
        slot = found.slots(keys)
        prints, at, many = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
        prints[slot], at[slot], many[slot] = (keys >> np.uint64(32)).astype("<u4"), first + nulls, count
        parts = [offsets, found.sizes.astype("<i8"), found.bits.astype("<u8"), prints, at, many]
        for x in parts:
            out.write(x.tobytes())
        out.write(FOOTER.pack(width, nulls, *(x.nbytes for x in parts), int(offsets[-1]), MAGIC))
    fs.move(tmp, f"{root}/shard-{shard:07d}.ids")
    return len(offsets) - 1, int(offsets[-1])


class Shard:
    """One shard file: its index in memory, its payload read by rows."""

    def __init__(self, folder: str, shard: int):
        fs, root = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{root}/shard-{shard:07d}.ids")
        end = self.file.size()
        self.width, self.nulls, *sizes, self.n_ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"shard {shard} of {folder} is not complete")
        at, parts = self.n_ids * self.width, []
        for size, kind in zip(sizes, ("<i8", "<i8", "<u8", "<u4", "<u4", "<u4"), strict=True):
            parts.append(np.frombuffer(self.file.read_at(size, at), kind))
            at += size
        self.offsets, levels, bits, self.prints, self.first, self.many = parts
        self.hash = PerfectHash(levels, bits)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The first row and the number of rows of each key; 0 rows where it is not in the shard."""
        hashes = key_hash(keys)
        slot = self.hash.slots(hashes)
        there = (slot >= 0) & (self.prints[slot] == (hashes >> np.uint64(32)).astype(np.uint32)) if len(self.prints) else np.zeros(len(keys), bool)
        first, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], many[there] = self.first[slot[there]], self.many[slot[there]]
        null = is_null(keys)
        first[null], many[null] = 0, self.nulls
        return first, many

    def ids(self, row: int, to: int) -> np.ndarray:
        """The ids of rows row to to - 1, as one array."""
        a, b = int(self.offsets[row]), int(self.offsets[to])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def pieces(self, rows: np.ndarray):
        """Ranges of `rows` (ascending) that are adjacent rows of READ_BYTES together, or a single row."""
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and rows[to] == rows[to - 1] + 1 and (self.offsets[rows[to] + 1] - self.offsets[rows[at]]) * self.width <= READ_BYTES:
                to += 1
            yield at, to
            at = to


class TokenStore:
    """A written store: folder, range bounds of its shards, and where each shard's ids begin in the whole."""

    def __init__(self, folder: str, bounds: list[int], rows: dict[int, int], ids: dict[int, int]):
        self.folder, self.bounds, self.rows, self.ids = folder, bounds, rows, ids
        self.starts, at = {}, 0
        for shard in sorted(ids):
            self.starts[shard], at = at, at + ids[shard]

    @classmethod
    def open(cls, folder: str) -> TokenStore:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            m = json.loads(f.read())
        return cls(folder, m["bounds"], {int(k): v for k, v in m["rows"].items()}, {int(k): v for k, v in m["ids"].items()})

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> TokenStore:
        spark = docs.sparkSession
        small_batches(spark)
        folder = folder or new_path(spark, "token-store")
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        cut = range_bounds(docs, key, LEAST_ROWS, MOST_ROWS)
        bounds = cut.tolist()

        def encoded(batches):
            run = encoder(tokenizer)
            end = b"" if end_id is None else np.array([end_id], run.dtype).tobytes()
            for b in merged(batches, ROWS):
                ids = [x + end for x in run.encode(b.column(1).to_pylist())]
                keys = b.column(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(range_of(keys, cut, np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))), pa.int32()), keys, pa.array(ids, pa.binary())], ["shard", "key", "ids"])

        def written(batches):
            width = encoder(tokenizer).dtype.itemsize
            for shard, parts in runs(batches, "shard"):
                rows, ids = _write_shard(folder, shard, ((b.column("key"), b.column("ids").to_pylist(), width) for b in parts))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([rows], pa.int64()), pa.array([ids], pa.int64())], ["shard", "n_rows", "n_ids"])

        ids = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encoded, "shard int, key long, ids binary")
        dealt = ids.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "ids")
        # one row for each shard
        made = {r.shard: (r.n_rows, r.n_ids) for r in dealt.mapInArrow(written, "shard int, n_rows long, n_ids long").collect()}
        store = cls(folder, bounds, {k: v[0] for k, v in made.items()}, {k: v[1] for k, v in made.items()})
        with fs.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"bounds": bounds, "rows": store.rows, "ids": store.ids}).encode())
        return store

    def lookup(self, keys: DataFrame, key: str = "doc_id", payload: bool = False) -> DataFrame:
        """Rows of the given keys, each key once: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) and, if asked for, ids."""
        small_batches(keys.sparkSession)
        folder, cut, starts = self.folder, np.array(self.bounds, np.int64), self.starts

        def placed(batches):
            for b in batches:
                x = b.column(0).cast(pa.int64())
                first, many = ranges_of(x, cut)
                at = np.repeat(np.arange(len(x)), many)
                shard = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), x.take(pa.array(at))], ["shard", "key"])

        def read(batches):
            for shard, parts in runs(batches, "shard"):
                if shard not in starts:
                    continue
                file, last = Shard(folder, shard), ()
                for b in parts:
                    x = b.column("key")
                    value, null = x.fill_null(0).to_numpy(zero_copy_only=False), is_null(x)
                    new = np.ones(len(x), bool)
                    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
                    new[0] = last != (value[0], null[0])
                    last = value[-1], null[-1]
                    x = x.filter(pa.array(new))
                    first, many = file.find(x)
                    which = np.repeat(np.arange(len(x)), many)
                    rows = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(which))
                    for a, z in file.pieces(rows):
                        some = rows[a:z]
                        ids = file.ids(int(some[0]), int(some[-1]) + 1).astype("<u4")
                        at = file.offsets[some] - file.offsets[some[0]]
                        n = file.offsets[some + 1] - file.offsets[some]
                        raw = memoryview(ids).cast("B")
                        cols = [
                            x.take(pa.array(which[a:z])), pa.array(starts[shard] + file.offsets[some]), pa.array(n),
                            pa.array([zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), n.tolist(), strict=True)], pa.int64()),
                        ]
                        if payload:
                            cols.append(pa.array([ids[i : i + k].astype(np.int32) for i, k in zip(at, n, strict=True)], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

        dealt = keys.select(F.col(key).alias("key")).mapInArrow(placed, "shard int, key long")
        dealt = dealt.repartitionById(len(self.bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_first())
        return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * payload)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    store = TokenStore.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    return store.lookup(docs)
