"""Byte-level BPE encoding and decoding by a file of ranks.

Pre-tokenisation is a scan over code point classes (pretok); every distinct piece is merged once and remembered
as the bytes of its ids, so that a text's ids are a join of remembered values. Decoding needs only the ids; the
byte offset of each piece in its text is kept with the id offset, so any piece can be decoded by itself.

Defined results: null and empty texts have no ids and decode to nothing; special strings are ordinary text;
repeated rows, ties and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, spare, trim
from .pretok import pieces

#: Pieces that a worker remembers, in two generations, and the longest one that it does.
CACHE_PIECES, CACHE_BYTES = 150_000, 64
#: Code points taken together.
CHUNK = 1 << 18
#: Instead of a rank, where a pair has none.
NONE = np.int32((1 << 31) - 1)
_loaded: dict[str, Ranks] = {}


class Ranks:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Every pair of tokens that makes a token, as sorted keys with the rank made, and pairs of bytes as a table."""
        rank = self.ranks.get
        pairs = [(a << 32 | b, made) for token, made in self.ranks.items() for i in range(1, len(token)) if (a := rank(token[:i])) is not None and (b := rank(token[i:])) is not None]
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.append(found[:, 0], np.int64(1 << 62)), np.append(found[:, 1], NONE).astype(np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self._rank_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, NONE where it has none; no token has a negative id."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_many(self, found: list[bytes]) -> list[bytes]:
        """merge() of short pieces side by side, as the bytes of their ids: each round joins one pair of every piece that has one left."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        width = int(sizes.max())
        data = np.zeros((len(found), width), np.uint8)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(found), np.uint8)
        ids = np.full((len(found), width + 1), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.byte_ids[data], -1)
        # ranks[:, i] is that of the pair at i and i + 1; the last columns have none
        ranks = np.full((len(found), width + 1), NONE, np.int32)
        pairs = self.byte_pairs[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]]
        ranks[:, : width - 1] = np.where(np.arange(1, width) < sizes[:, None], pairs, NONE)
        out, place, count = np.full((len(found), width), -1, np.int32), np.arange(len(found)), sizes.copy()
        while len(place):
            best = ranks.argmin(1)
            row = np.arange(len(place))
            made = ranks[row, best]
            done = made == NONE
            if done.any():
                out[place[done]] = ids[done, :width]
                going = ~done
                place, ids, ranks, best, made = place[going], ids[going], ranks[going], best[going], made[going]
                row = np.arange(len(place))
                if not len(place):
                    break
            count[place] -= 1
            # what stands after the pair moves one place to the left
            later = np.arange(width) > best[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ids[row, best] = made
            ranks[row, best] = self._rank_of(made, ids[row, best + 1])
            inner = np.flatnonzero(best)
            before = best[inner] - 1
            ranks[inner, before] = self._rank_of(ids[inner, before], made[inner])
        raw = out[np.arange(width) < count[:, None]].astype("<u4").tobytes()
        stops = (np.cumsum(count) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, the leftmost of equals, until no pair has a rank."""
        rank = self.ranks.get
        whole = rank(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
        return [self.ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and links, for pieces of any length."""
        import heapq

        n, rank = len(piece), self.ranks.get
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue
            alive[j] = False
            end[i], nxt[i] = to, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for a in (i, prev[i]):
                if a >= 0 and (b := nxt[a]) < n and (r := rank(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_pieces(self, found: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit integers."""
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES // 2:
            # pieces not seen since the last change are forgotten
            self.older, self.known = self.known, {}
            new = set(found)
        known, long = self.known, {}
        for piece in new.intersection(self.older):
            known[piece] = self.older[piece]
        widths: dict[int, list[bytes]] = {}
        for piece in new.difference(self.older):
            size = len(piece)
            if size > CACHE_BYTES:
                long[piece] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                widths.setdefault(size.bit_length(), []).append(piece)
        for some in widths.values():
            known.update(zip(some, self.merge_many(some), strict=True))
        if long:
            return [long[x] if len(x) > CACHE_BYTES else known[x] for x in found]
        return list(map(known.__getitem__, found))

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[int], np.ndarray]]:
        """Of each text: its ids, how many bytes of ids each piece has, and where pieces begin in its bytes."""
        found, index, offsets = pieces(texts)
        made = self.encode_pieces(found)
        return [(b"".join(made[a:b]), made[a:b], offsets[a:b]) for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def ranks(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def chunks(texts: list[str | None], most: int = CHUNK):
    """(start, texts) of about `most` code points each."""
    at, size, held = 0, 0, []
    for i, x in enumerate(texts):
        held.append(x or "")
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids binary (32-bit little-endian), piece_ids and piece_bytes: the id and byte offsets at which pieces begin."""
    small_batches(docs.sparkSession)

    def run(batches):
        table = ranks(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for at, some in chunks(texts):
                made = table.encode(some)
                id_at = [np.concatenate([[0], np.cumsum(np.fromiter(map(len, x[1]), np.int64, len(x[1])) // 4)[:-1]]).astype(np.int32) if x[1] else np.zeros(0, np.int32) for x in made]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, len(some)) for i in range(len(keep))), pa.array([x[0] for x in made], pa.binary()), pa.array(id_at, pa.list_(pa.int32())), pa.array([x[2].astype(np.int32) for x in made], pa.list_(pa.int32()))],
                    [*keep, "ids", "piece_ids", "piece_bytes"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias(spare(keep, "_text"))).mapInArrow(run, f"{kinds}, ids binary, piece_ids array<int>, piece_bytes array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and decoded binary; it sees nothing but the ids."""

    def run(batches):
        table = ranks(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([table.decode(x) for x in b.column(len(keep)).to_pylist()], pa.binary())], [*keep, "decoded"])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, F.col(ids).alias(spare(keep, "_ids"))).mapInArrow(run, f"{kinds}, decoded binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256: encode, then decode what the ids say, without sending ids through the JVM."""
    small_batches(docs.sparkSession)

    def run(batches):
        table = ranks(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for at, some in chunks(b.column(len(keep)).to_pylist()):
                ids = [x[0] for x in table.encode(some)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, len(some)) for i in range(len(keep))), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(table.decode(x)) for x in ids])],
                    [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        trim()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias(spare(keep, "_text"))).mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
