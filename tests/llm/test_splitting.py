"""Pieces: whole, small enough, overlapping, cut where they should be, and steady under edits."""

import random

import pytest

from arcweave.llm import bpe, splitting

LIMIT, OVERLAP = 60, 8


def prose(draw, blocks, lines, words):
    sentence = lambda: " ".join("".join(draw.choice("abcdeéstr'") for _ in range(draw.randint(1, 9))) for _ in range(words))
    return "\n\n".join("\n".join(sentence() for _ in range(lines)) for _ in range(blocks))


def cut(texts, limit=LIMIT, overlap=OVERLAP):
    tool = bpe.encoder()
    out = []
    for t in texts:
        ids, _ = tool.encode_bytes([t.encode()])
        out.append((splitting._Text(tool, t.encode(), ids), *splitting.split(tool, [splitting._Text(tool, t.encode(), ids)], limit, overlap)))
    return out


@pytest.mark.parametrize("text", [prose(random.Random(1), 12, 4, 6), prose(random.Random(2), 1, 1, 500), "x" * 3000, "日本語" * 300, " \n" * 900, "a\r\n\r\nb " * 300, "😀" * 400])
def test_pieces_cover_overlap_and_fit(text):
    tool = bpe.encoder()
    for whole, pieces in cut([text]):
        assert pieces[0][0] == 0 and pieces[-1][1] == len(whole.ids) and pieces[-1][2] == "end"
        for (_, end, kind, _), (start, *_) in zip(pieces, pieces[1:]):
            assert start == end - OVERLAP and kind in splitting.KINDS
        for start, end, _, piece in pieces:
            assert start < end and end - start <= LIMIT
            assert tool.encode_bytes([piece])[1][0] <= LIMIT
            piece.decode("utf-8")
        rebuilt = b""
        for start, end, _, piece in pieces:
            rebuilt += whole.bytes(start, end)[len(whole.bytes(start, start + OVERLAP)) if start else 0 :] if start else piece
        assert rebuilt == text.encode()


def test_cuts_fall_on_the_coarsest_boundary():
    text = prose(random.Random(3), 40, 2, 5)
    (whole, pieces), = cut([text])
    for start, end, kind, _ in pieces[:-1]:
        rest = text.encode()[whole.ends[end] :]
        white = rest[: len(rest) - len(rest.lstrip(b" \n"))]
        assert white, "a cut is at the end of a word"
        assert kind == ("block" if white.count(b"\n") >= 2 else "line" if white.count(b"\n") else "word")
    assert {p[2] for p in pieces[:-1]} == {"block"}
    (_, pieces), = cut([prose(random.Random(3), 1, 1, 300)])
    assert {p[2] for p in pieces[:-1]} == {"word"}


@pytest.mark.parametrize("text, kind", [
    ("a b c d e f g h i j k l\nm " + "Zq7" * 16 + " end of it" * 20, "line"),
    ("a b c d e f g h i j\n\n" + "k l m n o p q r s t u\n" * 30, "block"),
])
def test_an_early_boundary_goes_before_a_finer_one(text, kind):
    (whole, pieces), = cut([text])
    start, end, found, _ = pieces[0]
    assert found == kind and OVERLAP < end < LIMIT // 2


def test_a_run_after_a_short_start_is_not_cut():
    run = "Zq7xW" * 9
    tokens = len(bpe.encoder().encode_bytes([run.encode()])[0])
    assert LIMIT // 2 < tokens < LIMIT - OVERLAP
    (whole, pieces), = cut(["a b c d e f g h i j k l m n o p " + run + " q r s t" * 30])
    assert any(run.encode() in p for *_, p in pieces) and all(kind != "none" for *_, kind, _ in pieces)


def test_edits_alter_only_pieces_nearby():
    """At the sizes of production, over many edits of a long text: how many pieces an edit alters."""
    draw = random.Random(4)
    text = prose(draw, 500, 6, 8)
    (_, before), = cut([text], splitting.LIMIT, splitting.OVERLAP)
    known, altered = {p[3] for p in before}, []
    assert len(before) > 80
    for _ in range(25):
        at = text.index(" ", draw.randrange(len(text) * 9 // 10))
        edited = text[:at] + draw.choice([" an added word", "\n\nan added block of words", ""]) + text[at + draw.randrange(40) :]
        (_, after), = cut([edited], splitting.LIMIT, splitting.OVERLAP)
        altered.append(sum(p[3] not in known for p in after))
    altered.sort()
    print("pieces altered by an edit, of", len(before), ":", altered)
    assert altered[len(altered) // 2] <= 6 and sum(altered) / len(altered) <= 10


def test_pieces_that_do_not_join_raise():
    good = [(0, 50, "line", b""), (42, 90, "end", b"")]
    splitting._must_join(good, 90, LIMIT, OVERLAP)
    for bad in ([(0, 50, "line", b""), (43, 90, "end", b"")], [(0, 50, "line", b""), (42, 80, "end", b"")], [(0, 90, "end", b"")], [(1, 50, "line", b""), (42, 90, "end", b"")]):
        with pytest.raises(AssertionError):
            splitting._must_join(bad, 90, LIMIT, OVERLAP)


def test_checks_find_what_is_wrong(spark, monkeypatch):
    from pyspark.sql import functions as F

    draw = random.Random(9)
    rows = [(i, prose(draw, 12, 3, 4), "x") for i in range(6)] + [(20, None, "x"), (21, "", "x"), (22, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    right = splitting.checked(df, limit=LIMIT, overlap=OVERLAP).first()
    assert right.documents == 8 and sum(right) == 8
    plain = splitting.pieces
    second = F.col("piece") == 1
    changes = {
        "not_joined": lambda p: p.withColumn("first_token", F.col("first_token") + F.when(second, 1).otherwise(0)),
        "not_whole": lambda p: p.where(~second),
        "not_of_text": lambda p: p.withColumn("text", F.when(second, F.concat(F.lit("#"), "text")).otherwise(F.col("text"))),
        "over_limit": lambda p: p.withColumn("n_tokens", F.when(second, 999).otherwise(F.col("n_tokens"))),
        "over_limit_alone": lambda p: p.withColumn("text", F.when(second, F.repeat("text", 5)).otherwise(F.col("text"))),
        "wrong_cut": lambda p: p.withColumn("cut", F.when(second, "line").otherwise(F.col("cut"))),
        "wrong_boundary": lambda p: p.withColumn("boundary", F.lit(None).cast("string")),
    }
    for name, change in changes.items():
        monkeypatch.setattr(splitting, "pieces", lambda *a, _c=change: _c(plain(*a)))
        assert splitting.checked(df, limit=LIMIT, overlap=OVERLAP).first()[name] > 0, name


def test_landmarks_follow_content():
    draw = random.Random(5)
    tail = bytes(draw.randrange(256) for _ in range(20_000))
    plain, moved = splitting.landmarks(tail), splitting.landmarks(b"some other start" + tail)
    assert 5 < len(plain) < 60
    assert set(plain[plain > 80] + 16) == set(moved[moved > 96])


def _coarsest(text, limit):
    count = lambda t: len(bpe.encoder().encode_bytes([t.encode()])[0])
    blocks, now = [], []
    for line in text.split("\n") + [""]:
        if line.strip(" \t\r\n"):
            now.append(line)
        elif now:
            blocks.append("\n".join(now))
            now = []
    if all(count(b) <= limit for b in blocks):
        return "block"
    if all(count(x) <= limit for x in text.split("\n")):
        return "line"
    words = text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    return "word" if all(count(w) <= limit for w in words) else "none"


def test_coarsest_boundary_by_brute_force():
    draw = random.Random(8)
    texts = []
    for _ in range(150):
        text = prose(draw, draw.randint(1, 6), draw.randint(1, 6), draw.randint(1, 14))
        texts.append(draw.choice([text, text.replace("\n", "\r\n"), "\n \n" + text + "\n\t\n", text + "q" * draw.randint(0, 200), " " * 150 + "\n" + text]))
    got = splitting.coarsest(bpe.encoder(), [t.encode() for t in texts], 40)
    assert got == [_coarsest(t, 40) for t in texts] and set(got) == set(splitting.KINDS)


def test_column(spark):
    long = prose(random.Random(9), 40, 3, 3)
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "y" * 4000, "x"), (6, " " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = splitting.pieces(df, limit=LIMIT, overlap=OVERLAP).collect()
    own = {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
    assert 2 not in own and len(own[3]) == len(own[4]) == 1 and own[3][0].text == "" and own[4][0].boundary is None
    assert len(own[1]) == 2 * own[1][0].n_pieces and {r.boundary for r in own[1]} == {"block"}
    assert {r.boundary for r in own[None]} == {"none"} and all(r.n_tokens <= LIMIT for r in got)
    assert {r.boundary for r in own.get(6, []) if r.n_pieces > 1} <= {"block", "line", "word"}
    assert splitting.pieces(df.limit(0)).count() == 0
    assert "text" not in splitting.pieces(df, with_text=False).columns
    with pytest.raises(ValueError):
        splitting.pieces(df, limit=10, overlap=5)
