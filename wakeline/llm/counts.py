"""Token counts by finite-state transducers.

Two deterministic machines, both of which annotate transitions with counts of tokens:

* the pre-tokeniser (pretok): code point symbols are functions on eight states; functions of whole chunks
  compose through a parallel prefix scan, which gives every chunk its state before and so all piece starts;
* the merge machine below, over the bytes of a piece. The BPE of a prefix is fixed by its last token: it is the
  longest token that ends there and is compatible with the last token of what stands before it (two tokens are
  compatible if BPE leaves their concatenation as these two). A state holds what later bytes can depend on: the
  longest suffix that begins some token, and for each position in it the last token there and the count
  relative to now. A transition carries the change of the count, 1 - (tokens undone by the merge).

States are compiled when first reached, as there are far too many to list beforehand; when over MAX_STATES are held, the
table starts anew, so memory is bounded. All new pieces of a batch run through it side by side; pieces of over LONG bytes are cut into chunks.
A chunk's map gives the state after it and its count for states before it. It is known where it is asked for: first for the state
that the WARM bytes before the chunk lead to from the start, then for the states in which the chunk before ends. Maps of adjacent chunks
compose two and two, in a tree, until one map has the whole piece. So a long piece takes about as many steps as a
chunk has bytes. Counts of short pieces are remembered by piece.

Special strings of the tokenizer file split a text and count one each, as the library does by default.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows, ties and extra columns
change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_BYTES, chunks
from .common import documents, merged, small_batches, spare
from .pretok import pieces

LIMIT = 512
MAX_STATES = 120_000
#: Rows by which the table of transitions grows.
MORE_STATES = 16_384
#: Strings whose ends are remembered, and the count of a transition that isn't known.
MAX_GROWN, UNKNOWN = 200_000, -(1 << 15)
#: Rows and code points that are counted together: a long piece is walked byte by byte, so it should have company.
ROWS, CHUNK = 1000, 1 << 20
#: Pieces that a worker remembers.
CACHE_PIECES = 400_000
#: Bytes from which a piece is cut, of a chunk, and before a chunk that tell the likeliest state before it.
LONG, STEP, WARM = 4096, 1024, 128
_START = (b"", (-1,), (0,))
_loaded: dict[str, Counter] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level files write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeMachine:
    """Counts of BPE tokens of byte strings, by a transducer that grows as it is used."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.merges = tokens, merges
        self.text = {v: k for k, v in tokens.items()}
        self.prefixes = {k[:i] for k in tokens for i in range(len(k) + 1)}
        self.made_by = {made: (rank, a, b) for (a, b), (rank, made) in merges.items()}
        if len(self.made_by) < len(merges) or any(self.made_by[x][0] > rank for rank, a, b in self.made_by.values() for x in (a, b) if x in self.made_by):
            raise ValueError("merges out of order, or two of them that make one token")
        self.compatible: dict[tuple[int, int], bool] = {}
        self.grown: dict[bytes, tuple[list[tuple[int, int]], int]] = {}
        self.next, self.gain = np.empty((MORE_STATES, 256), np.int32), np.empty((MORE_STATES, 256), np.int16)
        self.clear()

    def clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ready = 0  # rows that are blank or in use; memory is taken as they are
        self._state(_START)

    def _state(self, name: tuple) -> int:
        found = self.names.get(name)
        if found is None:
            found = self.names[name] = len(self.states)
            self.states.append(name)
            if found >= self.ready:
                self._rows()
        return found

    def _rows(self) -> None:
        if self.ready == len(self.next):
            room = max(MAX_STATES, self.ready) + MORE_STATES
            for name in ("next", "gain"):
                held = getattr(self, name)
                made = np.empty((room, 256), held.dtype)
                made[: self.ready] = held
                setattr(self, name, made)
        to = min(self.ready + 1024, len(self.next))
        self.next[self.ready : to], self.gain[self.ready : to] = -1, UNKNOWN
        self.ready = to

    def _pair(self, left: int, right: int) -> bool:
        """Does BPE leave the two tokens' concatenation as these two?

        Merges that touch the border are looked at from the last one back: a pair across the border would have been
        merged if its rank comes before that of the merge which took either half away. It needs that a token is made
        by one merge, of a later rank than those which made its halves.
        """
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            found = self.compatible[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        merges, made_by = self.merges.get, self.made_by.get
        # the ranks of the merges that took the present halves away
        until_left = until_right = 1 << 60
        while True:
            across = merges((left, right))
            a, b = made_by(left), made_by(right)
            from_left, from_right = a[0] if a else -1, b[0] if b else -1
            # of equal ranks the leftmost goes first: merges in the left half before the pair across, and this before those in the right half
            if across is not None and across[0] < until_left and across[0] <= until_right:
                return False
            if a is None and b is None:
                return True
            if from_left > from_right:
                until_left, left = from_left, a[2]
            else:
                until_right, right = from_right, b[1]

    def merge(self, piece: bytes) -> list[int]:
        parts = [self.tokens[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(m[0], i, m[1]) for i, x in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.merges.get(x))]
            if not found:
                break
            _, i, made = min(found)
            parts[i : i + 2] = [made]
        return parts

    def _grown(self, grown: bytes) -> tuple[list[tuple[int, int]], int]:
        """Tokens that end a string, with their places, the longest first, and where its longest suffix that begins some token starts."""
        found = self.grown.get(grown)
        if found is None:
            if len(self.grown) > MAX_GROWN:
                self.grown.clear()
            ends = [grown[i:] for i in range(len(grown))]
            cut = next((i for i, x in enumerate(ends) if x in self.prefixes), len(grown))
            found = self.grown[grown] = [(i, t) for i, x in enumerate(ends[cut:], cut) if (t := self.tokens.get(x)) is not None], cut
        return found

    def compile(self, state: int, byte: int, last: bool = False) -> None:
        """Fill in the transition; only its count if no byte follows."""
        suffix, lasts, counts = self.states[state]
        tokens, cut = self._grown(suffix + bytes((byte,)))
        for i, token in tokens:
            if lasts[i] < 0 or self._pair(lasts[i], token):
                break
        else:
            raise ValueError("a byte without a token")
        gain = self.gain[state, byte] = counts[i] + 1
        if not last:
            name = (suffix[cut:] + bytes((byte,)) if cut <= len(suffix) else b"", (*lasts[cut:], token), (*(c - gain for c in counts[cut:]), 0))
            self.next[state, byte] = self._state(name)

    def _fill(self, state: np.ndarray, byte: np.ndarray, missing: np.ndarray, last: bool) -> None:
        if missing.any():
            for key in np.unique(state[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                self.compile(key >> 8, key & 255, last)

    def walk(self, found: list[bytes], names: list[tuple] | None = None) -> tuple[list[tuple], np.ndarray]:
        """The states after byte strings, and their counts; names has the state before each. Without it all begin at the start, and states aren't returned."""
        total = np.zeros(len(found), np.int64)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(found), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        state = np.zeros(len(found), np.int32) if names is None else np.array([self._state(names[i]) for i in order], np.int32)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k))  # those longer than k
            byte = data[begin[:live] + k]
            here = state[:live]
            # where states after strings aren't asked for, last bytes need no transition but its count
            more = int(np.searchsorted(-sizes, -(k + 1))) if names is None else live
            to = self.next[here, byte]
            self._fill(here[:more], byte[:more], to[:more] < 0, False)
            self._fill(here[more:], byte[more:], self.gain[here[more:], byte[more:]] == UNKNOWN, True)
            to[:more] = self.next[here[:more], byte[:more]]
            total[:live] += self.gain[here, byte]
            state[:more] = to[:more]
            if len(self.states) > MAX_STATES:
                # keep only the states that strings are in now
                used, place = np.unique(state, return_inverse=True)
                held = [self.states[s] for s in used.tolist()]
                self.clear()
                state = np.array([self._state(x) for x in held], np.int32)[place]
        out = np.zeros(len(found), np.int64)
        out[order] = total
        if names is None:
            return [], out
        ends = [_START] * len(found)
        for i, s in zip(order.tolist(), state.tolist(), strict=True):
            ends[i] = self.states[s]
        return ends, out

    def count(self, found: list[bytes]) -> np.ndarray:
        """Tokens of each byte string."""
        cut = [i for i, x in enumerate(found) if len(x) > LONG]
        if not cut:
            return self.walk(found)[1]
        starts = [(i, at) for i in cut for at in range(0, len(found[i]), STEP)]
        guess, _ = self.walk([found[i][max(0, at - WARM) : at] for i, at in starts], [_START] * len(starts))
        whole = [x if len(x) <= LONG else b"" for x in found]
        chunks = [found[i][at : at + STEP] for i, at in starts]
        ends, gains = self.walk(whole + chunks, [_START] * len(whole) + guess)
        out = gains[: len(whole)]
        maps = [{a: (z, n)} for a, z, n in zip(guess, ends[len(whole) :], gains[len(whole) :].tolist(), strict=True)]
        first = {i: k for k, (i, at) in reversed(list(enumerate(starts))) if not at}
        open_ = set(cut)
        while open_:
            for i in list(open_):
                size = -(-len(found[i]) // STEP)
                if (made := composed(maps[first[i] : first[i] + size]).get(_START)) is not None:
                    out[i] = made[1]
                    open_.discard(i)
            # states in which chunks end, that the map of the next doesn't have yet
            asked = [(k, z) for k in range(1, len(maps)) if starts[k][0] in open_ and starts[k][1] for z in {z for z, _ in maps[k - 1].values()} if z not in maps[k]]
            ends, gains = self.walk([chunks[k] for k, _ in asked], [z for _, z in asked])
            for (k, a), z, n in zip(asked, ends, gains.tolist(), strict=True):
                maps[k][a] = z, n
        return out


def composed(maps: list[dict[tuple, tuple[tuple, int]]]) -> dict[tuple, tuple[tuple, int]]:
    """The map of adjacent chunks, from each chunk's: state before to (state after, count), where all of them have it."""
    while len(maps) > 1:
        pairs = [{a: (g[z][0], n + g[z][1]) for a, (z, n) in f.items() if z in g} for f, g in zip(maps[::2], maps[1::2], strict=False)]
        maps = pairs + maps[len(pairs) * 2 :]
    return maps[0]


class Counter:
    """Counts as the tokenizers library has them for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or file["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        letters = byte_letters()
        tokens = {bytes(map(letters.__getitem__, k)): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        vocab = model["vocab"]
        merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        reachable = {k: v for k, v in tokens.items() if len(k) == 1} | {bytes(map(letters.__getitem__, k)): vocab[k] for k in ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])}
        self.machine = MergeMachine(reachable, merges)
        self.special = [x["content"] for x in file["added_tokens"]]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.known: dict[bytes, int] = {}

    def _split(self, text: str) -> tuple[list[str], int]:
        """What stands between special strings, and how many of these there are."""
        parts = [text]
        for x in sorted(self.special, key=len, reverse=True):
            if x in text:
                parts = [z for y in parts for z in y.split(x)]
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, x in enumerate(texts):
            mine, total[i] = self._split(x)
            parts += mine
            owner += [i] * len(mine)
        found, index, _ = pieces(parts)
        new = list(set(found).difference(self.known))
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(set(found))
        long = {}
        for piece, n in zip(new, self.machine.count(new).tolist(), strict=True):
            (self.known if len(piece) <= CACHE_BYTES else long)[piece] = n
        get = self.known.__getitem__
        each = np.fromiter((long[x] if len(x) > CACHE_BYTES else get(x) for x in found) if long else map(get, found), np.int64, len(found))
        sums = np.concatenate([[0], np.cumsum(each)])
        np.add.at(total, owner, sums[index[1:]] - sums[index[:-1]])
        return total


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(path).count
        for b in merged(batches, ROWS):
            for at, some in chunks(b.column(len(keep)).to_pylist(), CHUNK):
                n = count(some)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, len(some)) for i in range(len(keep))), pa.array([len(x.encode()) for x in some], pa.int64()), pa.array(n), pa.array(n > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"]
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias(spare(keep, "_text"))).mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
