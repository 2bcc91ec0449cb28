"""Pre-tokenisation without regular expressions.

The pattern of the public rank files,
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
is run as a finite-state machine. Each code point gets a class from an array; a look at the next two turns
it into a symbol (so look-ahead is part of the symbol); a symbol is a function from states to states, and
functions compose associatively. Blocks of symbols are composed side by side, a parallel prefix scan over the
blocks' functions gives the state before each block, and one more pass per block marks where pieces begin.
"""

from __future__ import annotations

import numpy as np

OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
#: Symbols: runs, an apostrophe that may open a contraction of two or three characters, white space in a run, and its last before something else.
O, L, N, A2, A3, W, S_LAST, W_LAST = range(8)
#: States: a piece ended; in a run of letters, numbers, others; after a space that joins what follows; in white space; one or two letters to go in a contraction.
END, IN_L, IN_N, IN_O, JOIN, IN_W, LAST1, LAST2 = range(8)
BLOCK = 128
_classes: np.ndarray | None = None


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol (8 more: the first of a text) and state."""
    to, begin = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(16):
        for state in range(8):
            s = END if symbol >= 8 else state
            kind = symbol % 8
            runs = {L: IN_L, N: IN_N, O: IN_O}
            if kind == L and s in (LAST1, LAST2):
                new, starts = (END if s == LAST1 else LAST1), False
            elif kind in (A2, A3) and s not in (IN_O, JOIN):
                new, starts = (LAST1 if kind == A2 else LAST2), True
            elif kind in (O, L, N, A2, A3):
                new = runs.get(kind, IN_O)
                starts = s not in (new, JOIN)
            elif kind == W:
                new, starts = IN_W, s != IN_W
            else:
                new, starts = (JOIN if kind == S_LAST else END), True
            to[symbol, state], begin[symbol, state] = new, starts
    return to, begin


_TO, _BEGIN = _machine()
_TO_FLAT, _BEGIN_FLAT = _TO.ravel(), _BEGIN.ravel()


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        import regex

        points = np.arange(0x110000, dtype=np.uint32)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        every = points.tobytes().decode("utf-32-le")
        found = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            found[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        found[0x20] = SPACE
        _classes = found
    return _classes


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first: marks the first code point of each text."""
    n = len(points)
    kind = classes()[points]
    out = np.array([O, L, N, W, W], np.uint8)[kind]
    white = kind >= SPACE
    before_more = np.zeros(n, bool)
    before_more[:-1] = ~white[1:] & ~first[1:]
    out[white & before_more] = W_LAST
    out[(kind == SPACE) & before_more] = S_LAST
    for at in (np.flatnonzero(points == 0x27),):
        after = at + 1
        ok = after < n
        at, after = at[ok], after[ok]
        ok = ~first[after]
        at, after = at[ok], after[ok]
        one = points[after]
        out[at[np.isin(one, [0x73, 0x74, 0x6D, 0x64])]] = A2
        ok = after + 1 < n
        at, after, one = at[ok], after[ok] + 1, one[ok]
        two = points[after]
        hit = ~first[after] & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        out[at[hit]] = A3
    return out + np.where(first, np.uint8(8), np.uint8(0))


def piece_starts(points: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Where pieces begin, for code points of many texts in a row."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-n // block)
    symbols = np.zeros(blocks * block, np.uint8)
    symbols[:n] = _symbols(points, first)
    base = (symbols.astype(np.int16) * 8).reshape(blocks, block).T.copy()
    # functions of whole blocks, composed symbol by symbol, all blocks side by side
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for k in range(block):
        maps = _TO_FLAT[base[k][:, None] + maps]
    # prefix scan: after it, maps[i] is the function of blocks 0 to i
    step = 1
    while step < blocks:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[np.uint8(END)], maps[:-1, END]])
    marks = np.zeros((block, blocks), bool)
    for k in range(block):
        at = base[k] + state
        marks[k] = _BEGIN_FLAT[at]
        state = _TO_FLAT[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces of all texts as UTF-8, each text's first piece (and the end), and each piece's byte offset in its text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.zeros(len(points), bool)
    first[begins[lengths > 0]] = True
    starts = piece_starts(points, first)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    data, at = joined.encode(), place[starts]
    to = np.append(at[1:], len(data))
    index = np.searchsorted(starts, np.append(begins, len(points)))
    offsets = at - np.repeat(place[begins], np.diff(index))
    return [data[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)], index, offsets
