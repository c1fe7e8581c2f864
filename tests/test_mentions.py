"""Forms in texts against a plain left-to-right search, and attributions of single chapters."""

import random
import re

from pyspark.sql import functions as F

from taleweave.functions import text as tx
from taleweave.operators import mentions as mn
from taleweave.plans import chapters as plans


def plain(text, forms):
    out, at = [], 0
    while at < len(text):
        fit = [f for f in forms if text.startswith(f, at) and not text[at - 1 : at].isalnum() and not text[at + len(f) : at + len(f) + 1].isalnum()]
        if at == 0:
            fit = [f for f in forms if text.startswith(f) and not text[len(f) : len(f) + 1].isalnum()]
        if fit:
            best = max(fit, key=len)
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, kind)


def test_scan_against_plain_search():
    r = random.Random(1)
    for _ in range(400):
        word = lambda: "".join(r.choice("ab漢") for _ in range(r.randint(1, 2)))
        text = "".join(r.choice([word(), " ", "-", ", "]) for _ in range(30))
        forms = list({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(6)} | {"a-b", "b, a"})
        assert mn.scan(text, forms) == mn._by_characters(text, forms) == plain(text, forms), (text, forms)
        odd = [*forms, "-a", "b,", "- b"]
        assert mn.scan(text, odd) == plain(text, odd), (text, odd)


def test_table_of_chapters(spark):
    r = random.Random(2)
    names = ["Lý Vân", "Vân", "An", "An Nhiên", "Hàn", "Hàn Lập", "Hàn Lập Nhân", "Trương-Tam", "O'Neil"]
    rows = [(k, " ".join(r.choice([*names, "đi", "nói", "HÀN", "Anh", "vân,"]) for _ in range(r.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "An" * 50)]
    got = sorted((x.chapter, x.form, x.times, x.first) for x in mn.found(frame(spark, "chapter long, text string", rows), frame(spark, "form string", [(n,) for n in [*names, *names, "--", "", "Không Có"]])).collect())
    want = []
    for k, text in rows:
        hits = plain(text or "", names)
        want += [(k, f, sum(h[2] == f for h in hits), min(h[0] for h in hits if h[2] == f)) for f in {h[2] for h in hits}]
    assert got == sorted(want)
    claims = [("Lý Vân", "A"), ("Vân", "A"), ("Vân", "B"), ("An", " C "), ("An", "C"), ("sư huynh", "D"), ("người áo đen", "D"), ("Hàn", ""), (None, "E")]
    assert {tuple(x) for x in mn.owned(frame(spark, "form string, owner string", claims)).collect()} == {("Lý Vân", "A"), ("An", "C")}


def test_attribution(spark):
    bible = frame(spark, "pos int, name string, aliases array<string>", [(0, "Hàn Lập", ["Hàn Lập", "Lão Hàn", "người áo đen"]), (1, "Mặc Đại Phu", ["kẻ bí ẩn kia"]), (2, "Lệ Phi Vũ", ["Lệ Phi Vũ"])])
    texts = [(1, "Người áo đen bước vào. Lệ Phi Vũ cười, Tiểu Lệ cũng cười."), (2, "Lão Hàn gặp người áo đen, hắn là Vương Ngũ."), (3, "Không ai cả.")]
    roster = [(1, 0, "Hàn Lập"), (1, 1, " Lệ Phi Vũ "), (1, 2, "Anonymous"), (1, 3, "Narrator"), (1, 4, ""), (2, 0, "Lão Hàn"), (2, 1, "Vương Ngũ"), (2, 2, "anonymous:anon-2"), (3, 0, "Mặc Đại Phu")]
    speakers = [(1, "a", "Hàn Lập"), (1, "b", "Lệ Phi Vũ"), (2, "a", "Lão Hàn"), (2, "b", "anonymous:anon-2"), (2, "c", "Người Lạ"), (3, "a", "Mặc Đại Phu")]
    told = [(1, "Tiểu Lệ", "Lệ Phi Vũ"), (1, "người áo đen", "Hàn Lập"), (1, "Không Có", "Lệ Phi Vũ"), (2, "Vương Ngũ", "Vương Ngũ"), (2, "Lão Hàn", "Hàn Lập"), (2, "hắn", "Vương Ngũ"), (2, "Lão", "Ai Đó"), (1, "cười", "Narrator")]
    rows = lambda kind, x: frame(spark, kind, x)
    out = mn.attribution(
        rows("chapter long, text string", texts), rows("chapter long, pos int, name string", roster), rows("chapter long, id string, speaker string", speakers),
        rows("chapter long, form string, owner string", told), rows("chapter long, name string", [(2, "Thêm")]), bible,
    )
    cast, lines, kept, alone = ({tuple(x) for x in df.collect()} for df in out)
    assert cast == {(1, 1, "Lệ Phi Vũ"), (1, 3, "Narrator"), (2, 0, "Lão Hàn"), (2, 1, "Vương Ngũ"), (2, 2, "anonymous:anon-2"), (3, 0, "Mặc Đại Phu")}
    assert lines == {(1, "a", "Anonymous"), (1, "b", "Lệ Phi Vũ"), (2, "a", "Lão Hàn"), (2, "b", "anonymous:anon-2"), (2, "c", "Người Lạ"), (3, "a", "Mặc Đại Phu")}
    assert kept == {(1, "Tiểu Lệ", "Lệ Phi Vũ"), (1, "cười", "Narrator"), (2, "Vương Ngũ", "Vương Ngũ"), (2, "Lão Hàn", "Hàn Lập")}
    assert alone == {(2, "Vương Ngũ")}


def test_word_borders_are_those_of_the_patterns():
    assert [m for m in re.findall(r"[^\W_]+", "a_b é1-漢")] == ["a", "b", "é1", "漢"]
    assert mn.scan("xAn An_ _An Anx", ["An"]) == [(4, 6, "An"), (9, 11, "An")]


def test_query_against_chapters_one_by_one(spark, data):
    """The same answers in plain Python, chapter by chapter."""
    frames = [sorted((tuple(r) for r in df.collect()), key=repr) for df in plans.answers(spark, data)]
    texts, roster, speakers, told, newcomers, bible = frames
    columns = plans.answers(spark, data)[-1].columns
    bible = sorted((dict(zip(columns, b, strict=True)) for b in bible), key=lambda b: b["pos"])
    low = lambda s: s.strip().lower()
    anonymous = lambda n: n == "Anonymous" or bool(re.fullmatch(r"anonymous:anon-\d+", n))
    epithet = lambda f: len(f.split()) > 2 and any(low(f).startswith(h + " ") for h in tx.DESCRIPTIVE_HEADS)
    bears = lambda f: low(f) not in {*tx.ALIAS_STOP, *tx.TITLE_SUFFIXES} and not epithet(f)
    inside = lambda f, text: bool(f.strip()) and any(h[2] == f for h in mn.scan(text, [f]))
    key = {}
    every = {x for row in (*speakers, *roster, *newcomers) for x in row[1:] if isinstance(x, str)} | {t[2] for t in told} | {x for b in bible for x in (b["name"], *b["aliases"])}
    for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", tx.canon_key(F.col("x")).alias("k")).collect():
        key[r.x] = r.k

    def resolved(name):
        for match in (lambda b: b["name"] == name, lambda b: name in b["aliases"], lambda b: key[b["name"]] == key[name], lambda b: key[name] in [key[a] for a in b["aliases"]]):
            if hit := next((b for b in bible if match(b)), None):
                return hit["name"]
        return name

    want = []
    for chapter, text in texts:
        mine = lambda rows: [r[1:] for r in rows if r[0] == chapter]  # noqa: B023, E731
        own_told = mine(told)
        aliases = {b["name"]: b["aliases"] for b in bible}
        named = lambda n: inside(low(n), text.lower()) or any(bears(f) and inside(low(f), text.lower()) for f in [*aliases.get(n, []), *[f for f, o in own_told if o == n]])  # noqa: B023, E731
        described = lambda n: any(epithet(f) and inside(low(f), text.lower()) for f in aliases.get(n, []))  # noqa: B023, E731
        unnamed = set()
        for name in {n for _, n in mine(roster)} | {s for _, s in mine(speakers)} | {o for f, o in own_told if epithet(f)}:
            r = resolved(name)
            if name and "Narrator" not in (name, r) and not anonymous(name) and not anonymous(r) and not named(r) and (described(r) or any(epithet(f) and o == name for f, o in own_told)):
                unnamed |= {name, r}
        speaking = {s for _, s in mine(speakers)}
        cast = {}
        for pos, n in sorted(mine(roster)):
            if n not in unnamed and (not anonymous(n) or n in speaking):
                cast.setdefault(n, pos)
        want += [(chapter, "roster", str(p), n) for n, p in cast.items()]
        want += [(chapter, "speaker", i, "Anonymous" if s in unnamed or resolved(s) in unnamed else s) for i, s in mine(speakers)]
        fresh = {n for (n,) in mine(newcomers)} - unnamed
        names = {b["name"] for b in bible}
        known = lambda n: n in names or resolved(n) != n  # noqa: B023, E731
        want += [(chapter, "newcomer", n, "unknown") for n in cast if n != "Narrator" and not anonymous(n) and not known(n) and n not in fresh]
        want += [(chapter, "mention", f, o) for f, o in set(own_told) if o not in unnamed and bears(f) and inside(f, text) and (o == "Narrator" or o in cast or o in fresh or known(o))]
    got = sorted((tuple(r) for r in plans.attribution(spark, data).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert {w[1] for w in want} == {"roster", "speaker", "mention", "newcomer"} - ({"newcomer"} if not any(w[1] == "newcomer" for w in want) else set())
