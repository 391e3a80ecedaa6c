"""Byte-level pre-tokenisation without a regular expression.

Every code point gets a class; a transition function of a nine-state automaton belongs to each class. Functions
compose associatively, so the states before all characters come from a prefix scan: blocks of 64 characters are
composed side by side, a doubling scan joins the blocks, and a second pass over the blocks reads off the boundaries.
The finitely many composed functions are numbered in advance, hence one table look-up composes two of them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Stands between documents; no code point.
GAP = 0x110000

# states: what the character before belongs to
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_LEFT, TWO_LEFT = range(8)
# classes of characters; CUT_SPACE and CUT_WHITE are the last white space before something else
LETTER, NUMBER, OTHER, CONTRACT1, CONTRACT2, WHITE, CUT_SPACE, CUT_WHITE, BREAK = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and starts[state, class]: whether a piece starts at a character."""
    nxt, new = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for state in range(8):
        for kind, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            nxt[state, kind], new[state, kind] = run, state not in (run, PREFIX)
        for kind, left in ((CONTRACT1, ONE_LEFT), (CONTRACT2, TWO_LEFT)):
            inside = state in (OTHERS, PREFIX)
            nxt[state, kind], new[state, kind] = OTHERS if inside else left, not inside
        nxt[state, WHITE], new[state, WHITE] = SPACES, state != SPACES
        nxt[state, CUT_SPACE], nxt[state, CUT_WHITE], nxt[state, BREAK] = PREFIX, FRESH, FRESH
    for state, after in ((ONE_LEFT, FRESH), (TWO_LEFT, ONE_LEFT)):  # letters that a contraction has claimed
        nxt[state, LETTER], new[state, LETTER] = after, False
    return nxt, new


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers of all composed transition functions: of each class, of f then g, what each makes of FRESH, and of the identity."""
    found: dict[bytes, int] = {}
    todo = [bytes(range(8)), *(nxt[:, c].tobytes() for c in range(9))]
    generators = todo[1:]
    while todo:
        f = todo.pop()
        if f not in found:
            found[f] = len(found)
            todo += [bytes(g[x] for x in f) for g in generators]
    functions = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)
    then = np.array([[found[bytes(functions[g][functions[f]])] for g in range(len(functions))] for f in range(len(functions))], np.uint16)
    return np.array([found[g] for g in generators], np.uint16), then, functions[:, FRESH].copy(), found[bytes(range(8))]


NEXT, STARTS = _automaton()
CLASS_FUNCTION, THEN, FROM_FRESH, IDENTITY = _monoid(NEXT)


def class_table() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point, and BREAK for GAP, by the tokenizer library's own Unicode tables.

    The library's matcher, asked for single letters, numbers or white space over all code points, returns exactly those.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(GAP + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(probe.encode_ordinary(every)).decode()
        out[np.frombuffer(members.encode("utf-32-le"), "<u4")] = kind
    out[GAP] = BREAK
    return out


def _classes(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes in context: what follows decides on the last white space of a run and on contractions."""
    kinds = table[points]
    white = kinds == WHITE
    last = white.copy()
    last[:-1] &= (kinds[1:] != WHITE) & (kinds[1:] != BREAK)
    last[-1:] = False
    kinds[last] = np.where(points[last] == 0x20, CUT_SPACE, CUT_WHITE)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.append(points, [GAP, GAP])
        a, b = padded[at + 1], padded[at + 2]
        kinds[at[np.isin(a, [ord(x) for x in "stmd"])]] = CONTRACT1
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        kinds[at[two]] = CONTRACT2
    return kinds


def boundaries(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; GAP starts one too."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // BLOCK)
    kinds = np.full(rows * BLOCK, BREAK, np.uint8)
    kinds[:n] = _classes(points, table)
    columns = np.ascontiguousarray(kinds.reshape(rows, BLOCK).T)
    whole = np.full(rows, IDENTITY, np.uint16)
    for kind in columns:
        whole = THEN[whole, CLASS_FUNCTION[kind]]
    step = 1
    while step < rows:  # doubling scan: whole[i] becomes the composition of blocks 0 to i
        whole[step:] = THEN[whole[:-step], whole[step:]]
        step *= 2
    state = np.concatenate([[FRESH], FROM_FRESH[whole[:-1]]]).astype(np.uint8)
    out = np.empty((BLOCK, rows), bool)
    for j, kind in enumerate(columns):
        out[j] = STARTS[state, kind]
        state = NEXT[state, kind]
    return out.T.reshape(-1)[:n]


def pieces(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts with one byte between, byte starts and ends of all pieces, and the number of pieces of each text."""
    joined = "\0".join(texts)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int32)
    gaps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1] - 1
    points[gaps] = GAP
    starts = boundaries(points, table)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[gaps] = 1
    at = np.append(np.cumsum(width) - width, len(data))
    where = np.flatnonzero(starts)
    begin, end = at[where], at[np.append(where[1:], len(points))] if len(where) else at[:0]
    real = points[where] != GAP
    text_of = np.searchsorted(gaps, where[real], side="right")
    return data, begin[real], end[real], np.bincount(text_of, minlength=len(texts))
