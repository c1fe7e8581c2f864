"""Rows and cues against every way to cut short texts."""

import itertools
import json
import random
import time

from pyspark.sql import functions as F

from taleweave.operators import cues, speech
from taleweave.plans import chapters as plans


def every_cut(n):
    for k in range(n):
        for inner in itertools.combinations(range(1, n), k):
            yield [*inner, n]


def test_rows_against_every_cut():
    r = random.Random(8)
    for _ in range(300):
        sizes, width, gap = [r.randint(1, 9) for _ in range(r.randint(1, 9))], r.randint(4, 14), r.randint(0, 2)
        span = lambda a, b: sum(sizes[a:b]) + gap * (b - a - 1)  # noqa: B023, E731
        fit = [c for c in every_cut(len(sizes)) if all(b - a == 1 or span(a, b) <= width for a, b in zip([0, *c], c, strict=False))]
        least = min(map(len, fit))
        cost = lambda c: sum(span(a, b) ** 2 for a, b in zip([0, *c], c, strict=False))  # noqa: B023, E731
        got = cues.balanced(sizes, gap, width)
        assert got in fit and len(got) == least and cost(got) == min(cost(c) for c in fit if len(c) == least)
    assert cues.balanced([], 1, 10) == []


def test_long_texts_take_linear_time():
    words = [f"w{k * 7919 % 1000}" for k in range(60_000)]
    began = time.process_time()
    rows = speech._balance(words, 42)
    assert time.process_time() - began < 10 and " ".join(rows) == " ".join(words) and max(map(len, rows)) <= 42


def test_shares():
    for weights, seconds in (([5, 5], 4.0), ([1, 9], 10.0), ([9, 1], 11.9), ([1] * 8, 3.0), ([3], 2.0), ([0, 0], 1.0), ([1, 1, 30], 17.0)):
        got = cues.shares(seconds, weights, 1.0, 6.0)
        assert abs(sum(got) - seconds) < 1e-9 or seconds < len(weights)
        assert all(s <= 6.0 + 1e-9 for s in got) and all(s >= 0 for s in got)
    assert cues.shares(10.0, [1, 4, 5], 1.0, 6.0) == [1.0, 4.0, 5.0]


def test_cues_keep_both_limits():
    r, style, width = random.Random(3), cues.Style(width=4_000, rows=2, least_s=1.0, most_s=6.0), cues.Widths().of
    for _ in range(300):
        words = ["".join(r.choice("abimwÀ漢") for _ in range(r.randint(1, 7))) + r.choice(["", "", "", ".", ",", "!"]) for _ in range(r.randint(1, 25))]
        label, start = r.choice(["", 'An: "', 'Lão Hàn: "']), r.uniform(0, 50)
        seconds = r.uniform(0.2, 40)
        got = cues.split("  ".join(words), start, start + seconds, label, width, style)
        text = [c[2].replace("\n", " ") for c in got]
        if label:
            assert all(t.startswith(label.strip()) and t.endswith('"') for t in text)
            text = [t[len(label.strip()) : -1] for t in text]
        assert " ".join(text).split() == words
        assert all(c[2].count("\n") < style.rows or len(t.split()) == 1 for c, t in zip(got, text, strict=True))
        assert all(line.count(" ") == 0 or width(line) <= style.width for c in got for line in c[2].split("\n"))
        single = all(len(t.split()) == 1 for t in text)
        assert single or all(b - a <= style.most_s + 1e-6 for a, b, _ in got)
        assert got[0][0] == start and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False)) and got[-1][1] <= start + seconds + 1e-9


def test_sentences_stay_whole():
    style, width = cues.Style(width=100_000, rows=1, most_s=100), lambda w: 1_000 * len(w)
    assert [c[2] for c in cues.split("One two. Three four! Five", 0, 10, "", width, cues.Style(width=21_000, rows=1, most_s=100))] == ["One two. Three four!", "Five"]
    assert [c[2] for c in cues.split("One two. Three four! Five", 0, 10, "", width, style)] == ["One two. Three four! Five"]
    assert [c[2] for c in cues.split("One two. Three four! Five", 0, 10, "", width, cues.Style(width=100_000, rows=1, most_s=4))] == ["One two.", "Three four!", "Five"]
    assert cues.split(" ", 0, 1, "", width, style) == []


def test_letters():
    assert [cues.letter_width(c) for c in ("i", "m", "A", "a", "漢", "é", "́")] == [300, 880, 680, 560, 1000, 560, 0]


def test_query_rows(spark, data):
    got = plans.cue_splitting(spark, data).collect()
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    by_turn = {}
    for g in got:
        by_turn.setdefault((g.conv_id, g.turn), []).append(g)
    assert set(by_turn) == {k for k, r in turns.items() if (r.text or "").split()}
    width = cues.Widths().of
    for key, rows in by_turn.items():
        r = turns[key]
        want = cues.split(r.text, r.turn * 100.0, r.turn * 100.0 + len(r.text) / 15.0, 'User: "' if r.role == "user" else "", width, cues.Style())
        assert [(g.start, g.end, g.text) for g in sorted(rows, key=lambda g: g.cue)] == [(round(a, 6), round(b, 6), t) for a, b, t in want]


def test_many_repairs():
    text = " ".join(f'say "w{k}" now' for k in range(700))
    assert json.loads(speech._repair('{"t": "' + text + '",}')) == {"t": text}


def test_split_is_null_safe(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0, None), ("", 0.0, 1.0, "x"), ("a b", 1.0, 2.0, None)], "t string, a double, b double, l string")
    assert [len(r.c) for r in df.select(cues.split_cues(F.col("t"), F.col("a"), F.col("b"), F.col("l")).alias("c")).collect()] == [0, 0, 1]
