"""Byte-level BPE encoding of whole columns of text, with numpy instead of a regular expression.

A batch of texts is one array of code points.  Each code point gets a *symbol*: its class (letter, number, space, other
white space, apostrophe, other) refined by the one or two code points after it, so that what the tokenizer's pattern
looks ahead for is part of the symbol.  The pattern is then a small automaton over symbols.  Its transition functions
are closed under composition and few, so a function is one byte, composition is one table look-up, and the state before
every code point comes from an associative scan: prefixes of all lanes are composed side by side, then the lanes.
A token's slice starts where state and symbol say so.  Slices go through a cache in front of the pair merging.

Defined results: a null and an empty text have no ids; bytes that are no UTF-8 count as U+FFFD; the strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# The endings that the pattern parts from a word, by letters after the apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
# Code points with the Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Code point classes.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE = range(6)
# Symbols; those from FIRST on are the same at the start of a text.
S_OTHER, S_LETTER, S_NUMBER, S_SPACE_LAST, S_WHITE_LAST, S_END_1, S_END_2, S_WHITE_MORE = range(8)
FIRST = 8
# States: what the current token is, after a code point.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after the symbol, and whether a token starts with it."""
    if symbol >= FIRST:
        return _step(DONE, symbol - FIRST)[0], True
    if symbol == S_LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (DONE if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (S_OTHER, S_END_1, S_END_2):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_END_1: ONE_LEFT, S_END_2: TWO_LEFT}[symbol], True
    if symbol == S_WHITE_MORE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == S_SPACE_LAST else DONE), True


class Automaton:
    """The transition functions of all strings of symbols: their table of composition, and how each acts on a state."""

    def __init__(self) -> None:
        generators = [tuple(_step(q, x)[0] for q in range(STATES)) for x in range(2 * FIRST)]
        identity = tuple(range(STATES))
        known = {identity: 0}
        queue = [identity]
        for f in queue:
            for g in generators:
                h = tuple(g[q] for q in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.size = len(known)
        assert self.size < 256
        self.compose = np.zeros((self.size, self.size), np.uint8)
        for f, i in known.items():
            for g, j in known.items():
                self.compose[i, j] = known[tuple(g[q] for q in f)]
        self.of_symbol = np.array([known[g] for g in generators], np.uint8)
        self.apply = np.array(queue, np.uint8)
        self.starts = np.array([[_step(q, x)[1] for x in range(2 * FIRST)] for q in range(STATES)], bool)

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol."""
        n = len(symbols)
        lanes = max(1, min(4096, n // 64))
        length = -(-n // lanes)
        functions = np.zeros(lanes * length, np.uint8)
        functions[:n] = self.of_symbol[symbols]
        functions = np.ascontiguousarray(functions.reshape(lanes, length).T)
        flat, before = self.compose.ravel(), np.empty((length, lanes), np.uint8)
        total, at = np.zeros(lanes, np.uint8), np.empty(lanes, np.intp)
        for t in range(length):
            before[t] = total
            np.multiply(total, self.size, out=at, dtype=np.intp, casting="unsafe")
            at += functions[t]
            total = flat.take(at)
        # Exclusive scan over the lanes, doubling the reach each time.
        scan, reach = total.copy(), 1
        while reach < lanes:
            scan[reach:] = self.compose[scan[:-reach], scan[reach:]]
            reach *= 2
        start = np.full(lanes, DONE, np.intp)
        start[1:] = self.apply[scan[:-1], DONE]
        at = before.astype(np.uint16)
        at *= STATES
        at += start.astype(np.uint16)
        return np.ascontiguousarray(self.apply.ravel().take(at).T).reshape(-1)[:n]


def _class_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = WHITE
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    return table


class _Cache(dict):
    """From a slice to its place in the pool of encoded slices; what is missing is merged when it is first asked for."""

    def __init__(self, merge, most: int) -> None:
        super().__init__()
        self.merge, self.most = merge, most
        self.ids, self.offsets = array("i"), array("q", [0])

    def __missing__(self, piece: bytes) -> int:
        self.ids.extend(self.merge(piece))
        self.offsets.append(len(self.ids))
        place = self[piece] = len(self.offsets) - 2
        return place

    def trim(self) -> None:
        """Called between batches, so that a worker's memory stays bounded."""
        if len(self) > self.most or len(self.ids) > 8 * self.most:
            self.clear()
            self.ids, self.offsets = array("i"), array("q", [0])


class Encoder:
    """Encodes batches of texts. One per worker and vocabulary: see encoder()."""

    def __init__(self, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, cache: int = 150_000) -> None:
        import tiktoken

        with open(os.path.join(directory, f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        merger = tiktoken.Encoding(vocabulary, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.cache = _Cache(merger._core_bpe.encode_single_piece, cache)
        self.automaton, self.classes = Automaton(), _class_table()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: where the texts start; none of them is empty."""
        classes = self.classes[points]
        n = len(points)
        white = (classes == SPACE) | (classes == WHITE)
        last = np.zeros(n, bool)  # white space before what is none
        last[:-1] = white[:-1] & ~white[1:]
        last[first[1:] - 1] = False
        symbols = classes  # OTHER, LETTER and NUMBER are their symbols
        symbols[white] = S_WHITE_MORE
        symbols[last] = np.where(points[last] == 0x20, S_SPACE_LAST, S_WHITE_LAST)
        marks = np.flatnonzero(points == 0x27)
        if len(marks):
            symbols[marks] = S_OTHER
            ends = np.append(first[1:], n)[np.searchsorted(first, marks, side="right") - 1]
            padded = np.append(points, np.zeros(2, points.dtype))
            a, b = padded[marks + 1], padded[marks + 2]
            one = np.isin(a, [ord(c) for c in ONE_LETTER]) & (marks + 1 < ends)
            two = np.zeros(len(marks), bool)
            for x, y in TWO_LETTERS:
                two |= (a == ord(x)) & (b == ord(y)) & (marks + 2 < ends)
            symbols[marks[one]], symbols[marks[two]] = S_END_1, S_END_2
        symbols[first] += FIRST
        return symbols

    def slices(self, data: bytes, text_starts: np.ndarray) -> np.ndarray:
        """Byte offsets in data at which tokens' slices start. text_starts: byte offsets of the texts, ascending, none empty."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        if len(points) == len(raw):
            first, offsets = text_starts, None
        else:
            offsets = np.flatnonzero((raw & 0xC0) != 0x80)
            first = np.searchsorted(offsets, text_starts)
        symbols = self._symbols(points, first)
        states = self.automaton.states_before(symbols)
        starts = np.flatnonzero(self.automaton.starts.ravel().take(states.astype(np.uint16) * (2 * FIRST) + symbols))
        return starts if offsets is None else offsets[starts]

    def _window(self, data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of data in a row, and the number of ids of each text."""
        self.cache.trim()
        starts = self.slices(data, text_starts)
        at = starts.tolist()
        get = self.cache.__getitem__
        places = np.fromiter((get(data[a:b]) for a, b in zip(at, [*at[1:], len(data)])), np.int64, len(at))
        pool, offsets = np.frombuffer(self.cache.ids, np.int32), np.frombuffer(self.cache.offsets, np.int64)  # not kept: the cache grows
        lengths = offsets[places + 1] - offsets[places]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(offsets[places] - (ends - lengths), lengths) + np.arange(ends[-1])]
        before = np.append(0, ends)[np.searchsorted(starts, np.append(text_starts, len(data)))]
        return ids, np.diff(before)

    def encode_bytes(self, texts: list[bytes], window: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the number of ids of each. A window's worth of text is in work at a time."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        parts: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
                ids, n = self._window(b"".join(parts), starts)
                out.append(ids)
                np.add.at(counts, owners, n)
                parts.clear()
                owners.clear()
                size = 0

        for i, text in enumerate(texts):
            for part in split_safely(text, window):
                parts.append(part)
                owners.append(i)
                size += len(part)
                if size >= window:
                    flush()
        flush()
        return (np.concatenate(out) if out else np.empty(0, np.int32)), counts

    def encode_arrow(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(utf8(column))


def split_safely(text: bytes, window: int):
    """Parts of a long text whose ids follow each other: a lone space between what is no white space starts a token."""
    a, n = 0, len(text)
    while n - a > window:
        b = a + window
        while True:
            b = text.find(b" ", b)
            if b < 0 or b + 1 >= n:
                b = n
                break
            if 0x21 <= text[b + 1] < 0x7F and 0x21 <= text[b - 1] < 0x7F:
                break
            b += 1
        yield text[a:b]
        a = b
    if a < n:
        yield text[a:]


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as valid UTF-8; null as empty."""
    texts = column.cast(pa.large_binary()).to_pylist()
    out = [t or b"" for t in texts]
    try:
        for t in out:
            t.decode("utf-8")
    except UnicodeDecodeError:
        out = [t.decode("utf-8", "replace").encode("utf-8") for t in out]
    return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder; it stays, with its cache, from task to task."""
    key = (directory, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(directory, vocabulary)
    return _ENCODERS[key]
