"""Rows of queries that SQL does not say, over whole tables, against plain Python."""

import math
import re

from pyspark.sql import functions as F

from taleweave.functions import text as tx
from taleweave.operators import speech
from taleweave.plans import chapters, sequential, web

SPACES = " \t\n\r\f\x0b"


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


def fold(line):
    """Marks and spaces one by one: a run with a space in it becomes its distinct marks."""
    out, k = [], 0
    while k < len(line):
        if line[k] not in ".!?…":
            out.append(line[k])
            k += 1
            continue
        last, m, spaced = k, k + 1, False
        while m < len(line) and line[m] in ".!?…" + SPACES:
            if line[m] in ".!?…":
                spaced |= m > last + 1
                last = m
            m += 1
        run = line[k : last + 1]
        out.append("".join(dict.fromkeys(run.translate({ord(c): None for c in SPACES}).replace(".", "…"))) if spaced else run)
        k = last + 1
    return "".join(out)


def test_folded_end_marks(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect() if r.text is not None}
    want = sorted((d, k, fold(line.replace(".", ". ."))) for d, t in texts.items() for k, line in enumerate(t.split("\n")))
    got = sorted((r.doc_id, r.line, r.folded) for r in web.fold_end_marks(spark, data).collect())
    assert got == want


def events(text):
    """Narration and dialogue by one walk over the characters."""
    out, start, at = [], 0, 0
    while at < len(text):
        c = text[at]
        if c == "\n":
            out.append(("narration", text[start:at]))
            start = at = at + 1
        elif c in '"“「':
            shut = next((k for k in range(at + 1, len(text)) if text[k] in '"”」'), None)
            if shut is not None:
                inner, line = text[at + 1 : shut].strip(), text[:at].split("\n")[-1].rstrip()
                rest = text[shut + 1 :].split("\n")[0].strip()
                if inner and len(inner) <= 24 and not re.search("[\n.!?…]", inner) and len(inner.split()) <= 4 and line and line[-1].isalnum() and rest:
                    at = shut + 1
                    continue
            out.append(("narration", text[start:at]))
            out.append(("dialogue", text[at + 1 : shut if shut is not None else len(text)]))
            start = at = (shut if shut is not None else len(text)) + 1
        else:
            at += 1
    out.append(("narration", text[start:]))
    return [(k, t.strip()) for k, t in out if t.strip()]


def test_quote_segmentation(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    want = sorted((d, k, *e) for d, t in texts.items() for k, e in enumerate(events(t or "")))
    assert sorted((r.chapter, r.pos, r.kind, r.text) for r in sequential.quote_segmentation(spark, data).collect()) == want


def test_embedded_terms(spark, data):
    want = {}
    for r in table(spark, data, "conversations").collect():
        text = " ".join(f'"{w}"' if k % 40 == 7 else w for k, w in enumerate((r.text or "").split(" ")))
        for kind, _ in events(text if r.text is not None else ""):
            key = r.conv_id * 100 + r.turn, kind
            want[key] = want.get(key, 0) + 1
    assert {(r.chapter, r.kind): r.n for r in chapters.embedded_term(spark, data).collect()} == want


def test_effect_windows(spark, data):
    spans = {}
    for r in sequential.slots(spark, data).withColumn("on", F.col("scene").isin("cave", "hall")).collect():
        spans.setdefault(r.chapter, []).append(r)
    want = []
    for chapter, rows in spans.items():
        budget, used, free = math.floor(max(r["end"] for r in rows) * 0.3), 0, 0
        for r in sorted(rows, key=lambda r: r.pos):
            at = max(r.start, free)
            if not r.on or r["end"] - r.start < 1500 or at >= r["end"]:
                continue
            if budget - used < 1500:
                break
            size = min(r["end"] - at, 9000, budget - used)
            if size >= 1500:
                want.append((chapter, r.pos, at, at + size))
                used, free = used + size, at + size + 2000
    assert sorted((r.chapter, r.span, r["from"], r["to"]) for r in sequential.effect_windows(spark, data).collect()) == sorted(want)
    assert len(want) > 20


def test_keyframes(spark, data):
    keys = {}
    for r in sequential.keyframes(spark, data).collect():
        keys.setdefault(r.chapter, []).append(r.pos)
    series = {r.vec_id: [float(x) for x in r.embedding] for r in table(spark, data, "embeddings").collect() if r.embedding}
    assert set(keys) == set(series)
    for chapter, y in series.items():
        k = sorted(keys[chapter])
        assert k[0] == 0 and k[-1] == len(y) - 1
        lines = [(a, b) for a, b in zip(k, k[1:], strict=False)]
        assert all(abs(y[a] + (y[b] - y[a]) * (i - a) / (b - a) - y[i]) <= 0.05 + 1e-9 for a, b in lines for i in range(a, b + 1))
        for a, b in lines[:-1]:  # a key is only set where the chord to the next frame leaves the tolerance
            chord = lambda i: y[a] + (y[b + 1] - y[a]) * (i - a) / (b + 1 - a)  # noqa: B023, E731
            assert any(abs(chord(i) - y[i]) > 0.05 - 1e-9 for i in range(a + 1, b + 1))


def test_short_chunks(spark, data):
    """Shortest first, each join seen from its outcome."""
    rows = table(spark, data, "conversations").select("conv_id", "turn", tx.minor_parts(F.col("text")).alias("chunks")).where(F.size("chunks") > 0)
    gap = F.transform("chunks", lambda x: F.when(x.contains("\n"), "para").otherwise(tx.gap_class(x)))
    got = {}
    for r in chapters.short_chunk_merge(spark, data).collect():
        got.setdefault((r.conv_id, r.turn), {})[r.chunk] = r.text
    seen = 0
    for r in rows.withColumn("gaps", gap).collect():
        own = [got[r.conv_id, r.turn][k] for k in range(len(got[r.conv_id, r.turn]))]
        assert " ".join(own) == " ".join(r.chunks) and (len(own) == 1 or min(map(len, own)) >= 30)
        seen += len(own) < len(r.chunks)
        chunks, gaps = list(r.chunks), list(r.gaps[:-1])
        while len(chunks) > 1 and min(map(len, chunks)) < 30:
            k = [len(c) for c in chunks].index(min(map(len, chunks)))
            right, left = k + 1 < len(chunks), k > 0
            join_right = right and (not left or (gaps[k] == "para", len(chunks[k + 1])) <= (gaps[k - 1] == "para", len(chunks[k - 1])))
            at = k if join_right else k - 1
            chunks[at : at + 2] = [chunks[at] + " " + chunks[at + 1]]
            gaps.pop(at)
        assert own == chunks
    assert seen


def test_balanced_rows(spark, data):
    turns = {(r.conv_id, r.turn): r.text for r in table(spark, data, "conversations").collect()}
    got = {}
    for r in chapters.balanced_lines(spark, data).collect():
        got.setdefault((r.conv_id, r.turn), {})[r.row] = r.line
    for key, rows in got.items():
        lines = [rows[k] for k in range(len(rows))]
        words = [w for w in re.split(f"[{SPACES}]+", turns[key]) if w]
        greedy, used = 1, -1
        for w in words:
            used += len(w) + 1
            if used > 42 and used > len(w):
                greedy, used = greedy + 1, len(w)
        assert " ".join(lines) == " ".join(words) and len(lines) == greedy and all(len(x) <= 42 or " " not in x for x in lines)
        assert lines == speech._balance(words, 42)


def test_quoted_sentences(spark, data):
    """Nothing but white space is lost, except parts without a letter or digit, and no cut lies inside paired quotes."""
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {}
    for r in chapters.quoted_sentences(spark, data).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.sentence
    for doc, sentences in got.items():
        text, at = texts[doc], 0
        paired = text.count('"') % 2 == 0 and len(re.findall(r"[(\[{]", text)) == len(re.findall(r"[)\]}]", text))
        for k in range(len(sentences)):
            found = text.find(sentences[k], at)
            assert found >= 0 and not re.search(r"[^\W_]", text[at:found])
            at = found + len(sentences[k])
            if paired:
                assert text.count('"', 0, at) % 2 == 0
        assert not re.search(r"[^\W_]", text[at:])


def test_racing_broadcasts_no_asks(spark, data):
    """Each supplier asks 150 times, which the planner does not count in: the asks meet the rows by a merge."""
    from taleweave import registry

    plan = registry.queries()["t05_racing"](spark, data)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [stage#" in line and ", k#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
