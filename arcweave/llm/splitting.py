"""Splitting texts over a limit of tokens, at boundaries that follow from the content.

Each text is encoded once.  A rolling hash over its bytes marks about one place in 2 ** MASK_BITS as a landmark.  From
the start of a piece, the first landmark between the least and the largest size of a piece is taken, or the largest size
if there is none, and the cut snaps to the nearest boundary, within these sizes, of the coarsest kind that occurs in the
piece behind the overlap: end of a block, line or word; where that kind occurs only before the least size, to the last
such boundary.  Only where there is none of any kind does it stay between two tokens.  The next piece begins `overlap`
tokens before the cut.  Where cuts fall depends on the text nearby, so an edit alters the pieces around it and the
following ones fall into step again at a landmark.

The white space after a word belongs to what follows, so every boundary is also a boundary between tokens of the text
as a whole.  A piece that would be over the limit when encoded by itself is cut earlier.

For each text over the limit, `boundary` is the coarsest kind of unit none of which, encoded by itself, is over it.

Defined results: a null text has no piece; an empty text, and any other within the limit, is one piece; a text is never
cut inside a character, so where a token ends inside one the piece's text begins with the whole character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import cut as cut_table
from ..plans.iterate import scoped
from ..plans.shipping import ship
from .bpe import TOKENIZER_DIR, VOCABULARY, Encoder, encoder, utf8
from .tokens import count_tokens, parts

LIMIT, OVERLAP = 1024, 64
MASK_BITS = 10
KINDS = ("block", "line", "word", "none")
_SPACES = b" \t\r\n"
_WHITE = re.compile(rb"[ \t\r\n]+")
_BLANK_LINES = re.compile(rb"\n(?:[ \t\r]*\n)+")


def _gear() -> np.ndarray:
    """256 pseudo-random numbers by a mixing rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def landmarks(text: bytes, bits: int = MASK_BITS) -> np.ndarray:
    """Byte offsets after which the hash of the last 64 bytes has `bits` leading zeros."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    reach = 1
    while reach < 64:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint64(reach))
        reach *= 2
    return np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1


def boundaries(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the ends of words, and the kind of each: 0 ends a block, 1 a line, 2 only a word."""
    raw = np.frombuffer(text, np.uint8)
    white = np.isin(raw, np.frombuffer(_SPACES, np.uint8))
    edge = np.diff(white.astype(np.int8))
    ends = np.flatnonzero(edge == 1) + 1
    if not len(ends):
        return ends, ends
    nexts = np.append(np.flatnonzero(edge == -1) + 1, len(raw))
    nexts = nexts[np.searchsorted(nexts, ends, side="right")]
    breaks = np.append(0, np.cumsum(raw == 10))
    lines = breaks[nexts] - breaks[ends]
    return ends, np.where(lines >= 2, 0, np.where(lines == 1, 1, 2))


def units(text: bytes, kind: str) -> list[bytes]:
    """The blocks, lines or words of a text, without what parts them."""
    if kind == "word":
        return [w for w in _WHITE.split(text) if w]
    if kind == "line":
        return text.split(b"\n")
    # A blank first or last line parts blocks as any other does.
    return [u.removeprefix(b"\n").removesuffix(b"\n") for u in _BLANK_LINES.split(b"\n" + text + b"\n")]


def coarsest(tool: Encoder, texts: list[bytes], limit: int = LIMIT) -> list[str]:
    """The coarsest sufficient kind of each text. A unit of at most `limit` bytes can't be over the limit in tokens."""
    out = ["none"] * len(texts)
    open_ = list(range(len(texts)))
    for kind in KINDS[:3]:
        suspects, owners = [], []
        for i in open_:
            for u in units(texts[i], kind):
                if len(u) > limit:
                    suspects.append(u)
                    owners.append(i)
        _, n = tool.encode_bytes(suspects)
        over = {i for i, k in zip(owners, n) if k > limit}
        for i in open_:
            if i not in over:
                out[i] = kind
        open_ = [i for i in open_ if i in over]
    return out


class _Text:
    """A long text with the places where it may be cut, all as numbers of tokens."""

    def __init__(self, tool: Encoder, text: bytes, ids: np.ndarray) -> None:
        self.text, self.ids = text, ids
        self.ends = np.append(0, np.cumsum(tool.token_bytes[ids], dtype=np.int64))  # byte offset before each token
        at, kinds = boundaries(text)
        place = np.searchsorted(self.ends, at)
        fits = self.ends[np.minimum(place, len(self.ends) - 1)] == at  # not inside a token, as after white space of other kinds
        self.at = [place[fits & (kinds == k)] for k in range(3)]
        self.marks = np.unique(np.searchsorted(self.ends, landmarks(text)))

    def cut(self, start: int, least: int, most: int, overlap: int) -> tuple[int, str]:
        """The end of the piece that begins at start, and the kind of boundary there."""
        low, high = start + least, start + most
        i = np.searchsorted(self.marks, low)
        aim = self.marks[i] if i < len(self.marks) and self.marks[i] <= high else high
        for kind, at in zip(KINDS, self.at):
            inside = at[np.searchsorted(at, low) : np.searchsorted(at, high, side="right")]
            if len(inside):
                return int(inside[np.argmin(np.abs(inside - aim))]), kind
            i = np.searchsorted(at, low) - 1
            if i >= 0 and at[i] > start + overlap:
                return int(at[i]), kind
        return int(aim), "none"

    def bytes(self, start: int, end: int) -> bytes:
        """A token that ends inside a character gives all of it to the piece that begins there."""
        a, b = int(self.ends[start]), int(self.ends[end])
        while a > 0 and self.text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(self.text) and self.text[b] & 0xC0 == 0x80:
            b -= 1
        return self.text[a:b]


def split(tool: Encoder, texts: list[_Text], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int, str, bytes]]]:
    """Pieces (start, end, kind of boundary at the end, text) of each text; the last one's kind is 'end'.

    All texts advance by one piece per turn, so that the pieces of a turn are encoded together for the check.
    """
    least = max(overlap + 1, limit // 2)
    out: list[list[tuple[int, int, str, bytes]]] = [[] for _ in texts]
    start = [0] * len(texts)
    open_ = list(range(len(texts)))
    while open_:
        todo, most = open_, dict.fromkeys(open_, limit)
        done: list[int] = []
        while todo:
            tries = []
            for i in todo:
                t, s, m = texts[i], start[i], most[i]
                rest = len(t.ids) - s
                e, kind = (s + rest, "end") if rest <= m else t.cut(s, min(least, m), m, overlap)
                tries.append((s, e, kind, t.bytes(s, e)))
            _, n = tool.encode_bytes([x[3] for x in tries])
            again = []
            for i, x, k in zip(todo, tries, n):
                if k <= limit or most[i] <= overlap + 1:  # a shorter piece would not get ahead of the overlap
                    out[i].append(x)
                    done.append(i)
                    start[i] = x[1] - overlap
                else:
                    most[i] = max(overlap + 1, min(x[1] - x[0] - 1, most[i] - int(k - limit)))
                    again.append(i)
            todo = again
        open_ = sorted(i for i in done if out[i][-1][2] != "end")
    return out


def _must_join(cuts: list[tuple[int, int, str, bytes]], tokens: int, limit: int, overlap: int) -> None:
    """Raise unless the pieces are within the limit, share the overlap and cover all tokens."""
    starts, ends = [c[0] for c in cuts], [c[1] for c in cuts]
    joined = starts == [0, *(e - overlap for e in ends[:-1])] and ends[-1] == tokens and cuts[-1][2] == "end"
    if not joined or any(not a < b <= a + limit for a, b in zip(starts, ends)):
        raise AssertionError(f"pieces of {tokens} tokens that do not join: {list(zip(starts, ends))[:5]}")


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, n_pieces, first_token, n_tokens, cut, boundary[, text]): `cut` is the kind of boundary at the piece's
    end, or 'end'; `boundary` is null for texts within the limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap is less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(directory, vocabulary)
        for batch in batches:
            for part in parts(batch, 1):
                part = part.filter(part.column(1).is_valid())
                raw = utf8(part.column(1))
                ids, counts = tool.encode_bytes(raw)
                upto = np.cumsum(counts)
                long = [i for i, n in enumerate(counts) if n > limit]
                kinds = dict(zip(long, coarsest(tool, [raw[i] for i in long], limit)))
                cuts = dict(zip(long, split(tool, [_Text(tool, raw[i], ids[upto[i] - counts[i] : upto[i]]) for i in long], limit, overlap)))
                for i in long:
                    _must_join(cuts[i], int(counts[i]), limit, overlap)
                owner, columns = [], ([], [], [], [], [], [], [])
                for i, t in enumerate(raw):
                    own = cuts.get(i) or [(0, int(counts[i]), "end", t)]
                    for k, (a, b, kind, own_text) in enumerate(own):
                        owner.append(i)
                        for c, v in zip(columns, (k, len(own), a, b - a, kind, kinds.get(i), own_text)):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                if with_text:
                    arrays.append(pa.array([t.decode("utf-8") for t in columns[6]], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *arrays], names)

    ship(documents.sparkSession)
    names = ["key", "piece", "n_pieces", "first_token", "n_tokens", "cut", "boundary"] + ["text"] * with_text
    kinds = [documents.schema[key].dataType, T.IntegerType(), T.IntegerType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


@scoped
def checked(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row: documents with pieces, and counts of what is wrong with pieces(), all 0 if nothing is. Keys are unique.

    over_limit: pieces over the limit, and over_limit_alone: when encoded by themselves, which is done anew here.
    not_joined: pieces that do not begin `overlap` tokens before the one in front ends. not_whole: documents whose pieces do
    not reach from the first token to the last, or are not numbered through. not_of_text: pieces that are no part of the
    text, or where the first is not at its start or the last at its end. wrong_cut: cuts of no known kind, and cuts at the
    end of a block, line or word where the white space in the text is that of another kind. wrong_boundary: a boundary for a document in one piece, or none for one in several.
    """
    made = cut_table(pieces(documents, key, text, limit, overlap, True, directory, vocabulary).withColumnRenamed(key, "_key"))
    alone = count_tokens(made, ["_key"], "text", directory, vocabulary).agg(F.count(F.when(F.col("n_tokens") > limit, 1)).alias("over_limit_alone"))
    sizes = count_tokens(documents.where(F.col(f"`{text}`").isNotNull()), [key], text, directory, vocabulary).select(F.col(key).alias("_key"), F.col("n_tokens").alias("all_tokens"))
    own = Window.partitionBy("_key").orderBy("piece")  # the pieces of one document
    wrong = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    joined = made.withColumn("start", F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens") - overlap).over(own), F.lit(0)))
    several, last = F.col("n_pieces") > 1, F.col("piece") == F.col("n_pieces") - 1
    known = F.when(last, F.col("cut") == "end").otherwise(F.col("cut").isin(*KINDS))
    by_piece = joined.agg(
        wrong(F.col("n_tokens") > limit, "over_limit"), wrong(F.col("first_token") != F.col("start"), "not_joined"),
        wrong(several != F.col("boundary").isNotNull(), "wrong_boundary"))
    whole = made.groupBy("_key").agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("reached"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("n_pieces"), F.countDistinct("piece").alias("numbers"), F.max("piece").alias("last"))
    whole = sizes.join(whole, "_key", "full").agg(
        F.count("n").alias("documents"),
        wrong(~((F.col("reached") == F.col("all_tokens")) & (F.col("n") == F.col("n_pieces")) & (F.col("numbers") == F.col("n")) & (F.col("last") == F.col("n") - 1)) | F.col("n").isNull(), "not_whole"))
    given = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_text is not null")
    inside = made.join(given, "_key")
    at = F.expr("locate(text, _text)")
    part = (at > 0) & ((F.col("piece") > 0) | F.expr("startswith(_text, text)")) & (~last | F.expr("endswith(_text, text)"))
    # What follows the piece, where the piece is in the text only once.
    rest = F.expr("substring(_text, locate(text, _text) + char_length(text), 2000)")
    once = F.expr("locate(text, _text, locate(text, _text) + 1) = 0")
    space = {"block": r"^[ \t\r]*\n[ \t\r]*\n", "line": r"^[ \t\r]*\n(?![ \t\r]*\n)", "word": r"^[ \t\r]+(?![ \t\r\n])"}
    no_end = F.lit(False)
    for kind, pattern in space.items():
        no_end = no_end | ((F.col("cut") == kind) & once & ~rest.rlike(pattern))
    in_text = inside.agg(wrong(~part, "not_of_text"), wrong(~known | no_end, "wrong_cut"))
    return whole.join(by_piece).join(alone).join(in_text).select("documents", "over_limit", "over_limit_alone", "not_joined", "not_whole", "not_of_text", "wrong_cut", "wrong_boundary")  # one row each
