"""Substring dedup against the plain definition."""

import random

import pytest

from chunkweave.llm import substrings
from chunkweave.llm.substrings import Windows, without_repeats

SCHEMA = "doc_id long, text string, block string, n_words string"


def plain(rows, width=20):
    """All windows in order of place; a word goes if a window over it occurred at an earlier place."""
    words = {i: (t or "").split(" ") if t else [] for i, t in rows if i is not None}
    words = {i: [w for w in " ".join(ws).translate(str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" ") if w] for i, ws in words.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s : s + width]), (i, s))
    out = {}
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s : s + width])] < (i, s):
                gone |= set(range(s, s + width))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "b", "x") for i, t in rows], SCHEMA).repartition(3)
    out = without_repeats(df)
    assert out.columns == ["doc_id", "text", "block", "n_words", "n_removed", "kept_text"]
    return [(r.doc_id, (r.n_words, r.n_removed, r.kept_text)) for r in out.collect()]


@pytest.mark.parametrize("seed", range(4))
def test_random_passages(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(r.choice([2, 30, 4000]))]
    passages = [r.choices(vocabulary, k=r.choice([19, 20, 21, 35, 60])) for _ in range(5)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(r.randint(0, 5)):
            ws += r.choice([r.choice(passages), r.choices(vocabulary, k=r.randint(1, 40)), [r.choice(vocabulary)] * r.randint(1, 45)])
        rows.append((i * 7 - 20, " ".join(ws)))
    assert dict(got(spark, rows)) == plain(rows)


def test_periodic_and_edges(spark):
    rows = [(1, "a " * 21), (2, " a b" * 30), (3, "a b c\t" * 15 + "a"), (4, None), (5, ""), (6, " \n\x0b "), (7, "x " * 19), (8, "x " * 19), (9, "x y z " * 25)]
    rows += [(10, "p\tq\n" * 5 + " ".join(map(str, range(3000)))), (11, " ".join(map(str, range(2990))))]
    want = plain(rows)
    assert dict(got(spark, rows)) == want
    assert want[11][1] == 2990 and want[7][1] == 0


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"k{i}" for i in range(30))
    out = got(spark, [(1, t), (1, t), (2, t), (None, t), (None, None)])
    assert sorted(x[1][1] for x in out if x[0] is not None) == [0, 0, 30]
    assert sorted(x[1] for x in out if x[0] is None) == [(0, 0, ""), (30, 0, t)]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = without_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == plain(rows)


def test_other_texts_of_a_doc_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(60))
    out = got(spark, [(1, a), (2, a), (2, b), (2, b), (3, None), (3, b + " c")])
    assert sorted(out) == [(1, (30, 0, a)), (2, (30, 30, "")), (2, (60, 0, b)), (2, (60, 0, b)), (3, (0, 0, "")), (3, (61, 60, "c"))]
    same = got(spark, [(5, "x " + a), (5, "y " + a), (4, b)])
    assert sorted(n for i, (_, n, _) in same if i == 5) == [0, 30]  # the text with the smaller hash is the earlier one


@pytest.mark.parametrize("width", [20, 23, 40])
def test_signatures_spell_windows(width):
    r = random.Random(width)
    texts = [" ".join(r.choice("ab" if k % 2 else "abcdefgh") * r.choice([1, 1, 1, 9]) for _ in range(120)).replace("", " ") for k in range(30)]
    w = Windows([t.encode() for t in texts], width)
    words = [x for t in texts for x in t.split()]
    names = dict(zip(w.at.tolist(), w.signatures(w.at).tolist()))
    spelt = {}
    for at, name in names.items():
        assert spelt.setdefault(tuple(words[at : at + width]), name) == name
    assert len(set(names.values())) == len(spelt)
    anchor, place = w.anchors()
    found = {}
    for at, a, p in zip(w.at.tolist(), anchor.tolist(), place.tolist()):
        known = found.setdefault(tuple(words[at : at + width]), (a, {}))
        assert known[0] == a and known[1].setdefault(p, at) == at  # equal windows: one anchor, at places of their own


def test_a_common_phrase_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_ROWS", 2)
    r = random.Random(1)
    phrase, passage = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(40))
    rows = [(i, " ".join([*(f"x{r.random()}" for _ in range(15)), phrase, *(f"y{r.random()}" for _ in range(15)), passage if i % 3 == 0 else ""])) for i in range(300, 0, -1)]
    assert dict(got(spark, rows)) == plain(rows)
