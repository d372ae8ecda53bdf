"""Speaker errors against all mappings, borders, joined windows, activity, and edits between word sequences."""

import itertools
import random

import numpy as np

from quillspark.functions.text import sequence_edits, word_edits
from quillspark.operators import speech


def test_best_mapping_equals_all_permutations():
    r = np.random.default_rng(4)
    for _ in range(300):
        n, m = r.integers(1, 6, 2)
        gain = r.integers(0, 9, (n, m)).astype(float)
        wide = gain if n <= m else gain.T
        want = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert speech.best_mapping(gain) == want


def covered(rows, key):
    """Which speakers speak in each millisecond."""
    out = {}
    for k, s, a, b in rows:
        if k == key and None not in (s, a, b):
            for t in range(a, b):
                out.setdefault(t, set()).add(s)
    return out


def test_speaker_errors_millisecond_by_millisecond(spark, monkeypatch):
    monkeypatch.setattr(speech, "PIECE", 50)
    r = random.Random(8)
    side = lambda names: [(k, r.choice(names), a := r.randint(0, 300), a + r.randint(0, 90)) for k in (1, 2, 3) for _ in range(9)]
    truth, found = side("abc"), [x for x in side("xyzw") if x[0] != 3] + [(1, None, 0, 9), (4, "x", 0, 10)]
    schema = "key long, speaker string, start_ms long, end_ms long"
    got = {x.key: x for x in speech.speaker_errors(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)).collect()}
    for k in (1, 2, 3):
        t, f = covered(truth, k), covered(found, k)
        speech_ms = sum(map(len, t.values()))
        best = max(sum(len({m[s] for s in own} & f.get(at, set())) for at, own in t.items()) for p in itertools.permutations("xyzw", 3) for m in [dict(zip("abc", p))])
        most = sum(max(len(t.get(at, ())), len(f.get(at, ()))) for at in t.keys() | f.keys())
        assert (got[k].speech_ms, got[k].right_ms, got[k].der) == (speech_ms, best, round((most - best) / speech_ms, 9))
    assert got[4].der is None and got[3].der == 1.0


def test_borders_and_activity(spark):
    schema = "key long, speaker string, start_ms long, end_ms long"
    truth = spark.createDataFrame([(1, "a", 0, 100), (1, "a", 200, 300), (2, "a", 0, 10)], schema)
    found = spark.createDataFrame([(1, "b", 5, 120), (1, "b", 190, 300)], schema)
    got = {x.key: (x.borders, x.within_ms) for x in speech.boundary_errors(truth, found).collect()}
    assert got == {1: (4, 20), 2: (2, None)}
    assert {x.within_ms for x in speech.boundary_errors(truth, found, share=0.5).filter("key = 1").collect()} == {5}
    levels = [(1, i, v) for i, v in enumerate([0, 9, 9, 9, 0, 9, 0, 0, 0, 9, 0])]
    found = speech.active(spark.createDataFrame(levels, "key long, no long, level long"), 5, gap_ms=10, least_ms=20).collect()
    assert [tuple(x) for x in found] == [(1, 10, 60)]


def test_windows_joined_give_the_text(spark):
    text = [f"w{i}" for i in range(200)]
    rows = [(k, no, " ".join(text[a : a + 20])) for k in (1, 2) for no, a in enumerate(range(0, 200, 15))] + [(3, 0, None), (3, 1, "a b"), (3, 2, "b"), (3, 3, "c d"), (4, 0, "x y z"), (4, 1, "z w")]
    random.Random(2).shuffle(rows)
    got = {x.key: x.text for x in speech.joined_windows(spark.createDataFrame(rows, "key long, no long, text string")).collect()}
    assert got[1] == got[2] == " ".join(text) and got[3] == "a b c d" and got[4] == "x y z z w"
    r = random.Random(3)
    for _ in range(500):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 6))] for _ in range(2))
        n = max(n for n in range(min(len(a), len(b)) + 1) if a[len(a) - n :] == b[:n])
        assert speech.overlap(a, b, 1) == n


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edits_between_words_of_any_number(spark):
    r = random.Random(5)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert sequence_edits(a, b) == plain_edits(a, b)
    many = [f"w{i}" for i in range(40_000)]
    other = many[1:20_000] + ["x"] + many[20_000:39_000] + many[39_500:]
    df = spark.createDataFrame([(many, other), (["a"], None), ([], ["a", "b"])], "a array<string>, b array<string>")
    assert sorted((x[0] is None, x[0]) for x in df.select(word_edits(df.a, df.b)).collect()) == [(False, 2), (False, 502), (True, None)]
