"""Operators that SQL cannot say, against plain Python, and small facts of text and pages."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from taleweave.functions import bits, markup, voice, web
from taleweave.functions import text as tx
from taleweave.operators import pages, resolve, sequential, speech


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_batches(spark):
    rng = random.Random(1)
    rows = [(c, k, "x" * rng.randint(1, 200) + rng.choice([".", "! ", " no end", '."'])) for c in range(5) for k in range(30)]
    got = sorted(tuple(r) for r in sequential.batches(spark.createDataFrame(rows, "chapter long, pos long, text string"), 4, 600).collect())
    want = []
    for c in range(5):
        chars = ends = lines = window = 0
        for _, k, t in [r for r in rows if r[0] == c]:
            chars, ends, lines, closed = chars + len(t) + 64, ends + len(re.findall(r"[.!?…]", t)), lines + 1, bool(re.search(r'[.!?…]["”]*\s*\Z', t))
            if k == 29 or ends >= 4 and closed or chars >= 600 and (closed or chars >= 900):
                want.append((c, window, k, lines, chars, ends))
                chars, ends, lines, window = 0, 0, 0, window + 1
    assert got == want


def test_effect_windows(spark):
    rng = random.Random(2)
    rows, want = [], []
    for c in range(6):
        t, spans = 0, []
        for k in range(20):
            n = rng.randint(100, 4000)
            spans.append((c, k, t, t + n, rng.random() < 0.6))
            t += n
        rows += spans
        budget, used, free = int(t * 0.4), 0, 0
        for _, k, a, b, on in spans:
            at = max(a, free)
            if not on or b - a < 800 or at >= b:
                continue
            if budget - used < 800:
                break
            size = min(b - at, 2000, budget - used)
            if size >= 800:
                want.append((c, k, at, at + size))
                used, free = used + size, at + size + 500
    df = spark.createDataFrame(rows, "chapter long, pos long, start long, end long, on boolean")
    assert sorted(tuple(r) for r in sequential.effect_windows(df, 0.4, 800, 2000, 500).collect()) == want


def test_keyframes_stay_within_tolerance(spark):
    rng = random.Random(3)
    series = []
    for c in range(4):
        y, points = 0.0, []
        for k in range(60):
            y += rng.uniform(-0.2, 0.25)
            points.append((k, y))
        series.append((c, points))
    df = spark.createDataFrame(series, "chapter long, items array<struct<pos:long,y:double>>")
    keys = {c: sorted(r.pos for r in sequential.decimate(df, 0.15).where(F.col("chapter") == c).collect()) for c in range(4)}
    for c, points in series:
        ys = dict(points)
        assert keys[c][0] == 0 and keys[c][-1] == 59 and len(keys[c]) < 60
        for a, b in zip(keys[c], keys[c][1:]):
            for k in range(a, b + 1):
                assert abs(ys[a] + (ys[b] - ys[a]) * (k - a) / (b - a) - ys[k]) <= 0.15 + 1e-9


def test_quote_events(spark):
    text = 'He said "go" quietly.\n“Come in.” She sat.\nThe "rear palace" was lit.\n「Ở đây」 "open'
    rows = sequential.quote_events(spark.createDataFrame([(1, text), (2, None), (3, "")], "chapter long, text string")).collect()
    got = [(r.kind, r.text, r.open) for r in sorted(rows, key=lambda r: r.pos)]
    assert got == [
        ("narration", 'He said "go" quietly.', False), ("dialogue", "Come in.", False), ("narration", "She sat.", False),
        ("narration", 'The "rear palace" was lit.', False), ("dialogue", "Ở đây", False), ("dialogue", "open", True),
    ]
    for r in rows:
        assert text[r["from"] : r.to].strip() == r.text


def test_packed(spark):
    rng = random.Random(4)
    parts = [["w" * rng.randint(1, 70) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    for p, r in zip(parts, spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k long, p array<string>").select("k", sequential.packed(F.col("p"), 64).alias("c")).orderBy("k").collect(), strict=True):
        out, cur = [], ""
        for w in p:
            size = len(cur) + 1 + len(w) if cur else len(w)
            if size <= 64 or len(w) <= 8 and size <= 72:
                cur = f"{cur} {w}" if cur else w
            else:
                out, cur = [*out, *([cur] if cur else [])], w
        assert list(r.c) == [*out, *([cur] if cur else [])]


def test_sentences_and_short_chunks(spark):
    cut = lambda t: list(value(spark, speech.quoted_sentences(F.lit(t))))
    assert cut('One. Two "a. b." three! ') == ["One.", 'Two "a. b." three!']
    assert cut("A (see. this) b. C?") == ["A (see. this) b.", "C?"]
    assert cut('Odd " quote. Next.') == ['Odd " quote.', "Next."]
    assert cut("Wait. . . what?! ... ") == ["Wait. . .", "what?! ..."]
    assert speech._merge(["aaaaaaaa", "b", "cc", "dddd"], ["sentence", "para", "minor"], 3) == ["aaaaaaaa b", "cc dddd"]
    assert speech._merge(["a"], [], 5) == ["a"]


def test_balanced_lines():
    words = "the quick brown fox jumps over the lazy dog again".split()
    rows = speech._balance(words, 20)
    assert " ".join(rows) == " ".join(words) and len(rows) == 3
    best = min(
        sum(len(" ".join(words[a:b])) ** 2 for a, b in zip((0, i, j), (i, j, len(words)))) for i in range(1, len(words) - 1) for j in range(i + 1, len(words))
    )
    assert sum(len(r) ** 2 for r in rows) == best and speech._balance([], 10) == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('{"t": "line\nbreak"}', {"t": "line\nbreak"}), ('{"t": "he said "no" loud"}', {"t": 'he said "no" loud'}), ('{\\"a\\": 1}', {"a": 1}), ("nothing", None), (None, None)],
)
def test_json_repair(raw, want):
    got = speech._repair(raw)
    assert (json.loads(got) if got else None) == want


def test_split_mix_and_fnv(spark):
    mask = (1 << 64) - 1

    def mix(s):
        z = (s + bits.MIX_STEP) & mask
        z = ((z ^ (z >> 30)) * bits.MIX_1) & mask
        z = ((z ^ (z >> 27)) * bits.MIX_2) & mask
        return z ^ (z >> 31)

    for s in (0, 1, 12345, mask):
        assert int(value(spark, bits.split_mix(F.lit(str(s)).cast("decimal(38,0)")))) == mix(s)
    h = bits.FNV_START
    for b in "Chương 1".encode():
        h = ((h ^ b) * bits.FNV_PRIME) & mask
    assert int(value(spark, bits.fnv1a(F.lit("Chương 1")))) == h


def test_markup(spark):
    v = lambda c: value(spark, c)
    assert v(markup.decode_entities(F.lit("a &amp;lt; &#65;&#x42; &#38;lt; &bogus; &nbsp;&#99999999;"))) == "a &lt; AB &lt; &bogus;  &#99999999;"
    assert v(markup.text_of(F.lit("<p>a</p><script>if (a<b) x()</script>b<br/>c<a <p>d<style>x"))) == "\na\nb\ncd"
    assert v(markup.fold_end_marks(F.lit("Wait . . . what ! ? Really?! Yes."))) == "Wait … what !? Really?! Yes."
    assert v(markup.prose(F.lit(" a \n...\n\n b &amp; c\n"))) == "a\n\nb & c\n" and v(markup.prose(F.lit(" . . \n"))) == ""
    assert v(web.expand_template(F.lit("/{n}/{n:03}/{x}"), F.lit(7))) == "/7/007/{x}"
    assert [v(web.host(F.lit(u))) for u in ("http://user:pw@WWW.Site.example:8443/a", "site.example/a?b")] == ["site.example", "site.example"]


def test_small_facts(spark):
    v = lambda c: value(spark, c)
    assert v(tx.canon_key(F.lit("Huyền  Vũ lão tổ"))) == "huyền vũ" and v(tx.canon_key(F.lit("lão tổ"))) == "lão tổ" and v(tx.canon_key(F.lit("Anna (young)"))) == "anna"
    assert v(voice.mood_cluster(F.lit(""))) == "neutral" and v(voice.mood_cluster(F.lit("sarcastic"))) == "amused" and v(voice.mood_cluster(F.lit("descriptive, flat"))) == "neutral"
    assert v(voice.voice_hint(F.lit("old woman, soft"))) == "elderly female: old woman, soft" and v(voice.hint_gender(F.lit("adult female, cold"))) == "female"
    assert v(tx.normal_tags(F.array(F.lit("elderly"), F.lit("powerful"), F.lit("old")))) == ["old", "strong"]
    assert v(tx.fold(F.lit("Đường Ấn"))) == "duong an" and v(tx.number_in_name(F.lit("chapter-7.5.txt"))) is None
    assert v(tx.thought(F.lit("He ran, she hid, and then I left."))) is False and v(tx.thought(F.lit("Well, I left."))) is True


def test_readable_page(spark):
    html = "<html><head><title>Index</title></head><body><nav><a href='/a'>Start</a><a href='b?x=1'>End</a></nav><article><h1>One &amp; two</h1><p>First line.</p><p>Second.</p></article></body></html>"
    df = spark.createDataFrame([(1, html, "http://h.example/x/y"), (2, "", "http://h.example/"), (3, "<p>no close <b>x", "http://h.example/")], "page_id long, html string, url string")
    got = {r.page_id: r for r in pages.readable(pages.parsed(df)).collect()}
    assert got[1].title == "One & two" and got[1].text == "One & two\n\nFirst line.\n\nSecond."
    links = {(r.n, r.url, r.title) for r in pages.listing(df).collect()}
    assert links == {(1, "http://h.example/a", "Start"), (2, "http://h.example/x/b?x=1", "End")}


def test_nothing_breaks_on_empty_tables(spark):
    from taleweave.operators import ledger, resolve, timeline

    slots = spark.createDataFrame([], "chapter long, pos long, speaker string, scene string, music string, dur long, gap long, pause long")
    laid = timeline.layout(slots)
    assert timeline.spans(laid, ["scene"]).count() == timeline.music_runs(laid).count() == timeline.beats(laid, 2).count() == 0
    cast = spark.createDataFrame([], "pos long, name string, aliases array<string>")
    assert resolve.resolve(spark.createDataFrame([("A",), (None,)], "speaker string"), cast).count() == 2
    tasks = spark.createDataFrame([], "chapter long, take int, stage string, state string, worker string, racers array<string>, lease_until long, attempts long")
    assert ledger.progress(tasks).count() == 0 and ledger.upstream_done(tasks).count() == 0


def test_quote_findings_and_repair_verdicts(spark):
    from taleweave.operators import audit

    long = "word " * 30
    text = f'He went "{long}".\n“One\ntwo”\nShe said: "{long}" and "left'
    chapters = spark.createDataFrame([(1, text)], "chapter long, text string")
    assert sorted(r.kind for r in audit.quote_findings(chapters).collect()) == ["swallowed paragraph", "unclosed quote", "welded prose"]
    bodies = ["not json at all", "{}", '{"text": ""}', json.dumps({"text": 'One.\n"I go."\nTwo.'}), json.dumps({"text": 'One.\n"I go.\nTwo.'}), json.dumps({"text": 'One.\n"I go.\n\nFar."\nTwo.'})]
    got = audit.repair_verdicts(spark.createDataFrame(list(enumerate(bodies)), "chapter long, body string"))
    assert [r.verdict for r in got.orderBy("chapter").collect()] == ["no json", "no text", "empty", "accepted", "faulty", "accepted"]


def test_speech_bursts(spark):
    from taleweave.operators import audit

    clicks = lambda n: ([0.5] * 40 + [0.0] * 60) * n
    rows = [(clicks(3), "ti tø", 30, 10), (clicks(2), "ti tø", 30, 10), (clicks(1), "ti", 13, 12), (clicks(1), "ti", 13, 8), ([0.0] * 100, "ti", 30, 1), ([0.5] * 40 + [0.0] * 2 + [0.5] * 40, "ti", 30, 1), ([], "ti", 30, 1), (clicks(5), "ti<|emotion_1|>", 30, 29), (clicks(5), "<|emotion_1|>", 30, 29)]
    df = spark.createDataFrame(rows, "wav array<double>, said string, cap int, frames int")
    got = [tuple(r.v) for r in df.select(audit.babble(F.col("wav"), 200, F.col("said"), F.col("cap"), F.col("frames")).alias("v")).collect()]
    assert got == [(True, 2, 3), (False, 2, 2), (True, 1, 1), (False, 1, 1), (False, 1, 0), (False, 1, 1), (False, 1, 0), (False, 1, 0), (True, 0, 0)]


def test_upsert_takes_finds_in_their_order(spark):
    """Against one find after the other in plain Python; the keys here are the lower-cased names."""
    rng = random.Random(5)
    names, forms = ["Ann", "ann", "Bo", "Cy", "DI", "di", " ", "Ta"], ["Red", "red", "Owl", "x", "ta", "Bo", "Fox", "Di", "sư phụ"]
    cast = [(k, n, rng.sample(forms, 2), [k]) for k, n in enumerate(["Ann", "Eve"])]
    found = [(k, k // 3, rng.choice(names), rng.sample(forms, rng.randrange(4))) for k in range(30)]
    said = [(rng.randrange(12), rng.choice(["ANN", "bo", "di", "nobody", "eve"])) for _ in range(30)]
    stop = {"ta", "sư phụ"}
    people = {n.lower(): [n, [a for a in al if a not in stop], set(ch), None] for _, n, al, ch in cast}
    for _, chapter, name, aliases in found:
        name = name.strip()
        if not name:
            continue
        new = name.lower() not in people
        who = people.setdefault(name.lower(), [name, [], set(), chapter])
        for k, form in enumerate([name, *aliases]):
            taken = any(form.lower() in [a.lower() for a in p[1]] for key, p in people.items() if key != name.lower())
            usable = new and k == 0 or len(form) > 1 and form.lower() not in stop
            if usable and not taken and form not in who[1]:
                who[1].append(form)
    for chapter, speaker in said:
        who = people.get(speaker.lower())
        if who and (who[3] is None or chapter >= who[3]):
            who[2].add(chapter)
    frames = (
        spark.createDataFrame(cast, "pos long, name string, aliases array<string>, chapters array<long>"), spark.createDataFrame(found, "at long, chapter long, name string, aliases array<string>"),
        spark.createDataFrame(said, "chapter long, speaker string"),
    )
    got = {r["name"]: (r.aliases, r.chapters, r.first_seen) for r in resolve.upsert(*frames).collect()}
    assert got == {p[0]: (p[1], sorted(p[2]), p[3]) for p in people.values()}
    assert not resolve.upsert(*(f.limit(0) for f in frames)).collect()


def _bible(spark, *characters):
    rows = [(k, name, aliases, [], "x", "adult male", ["male"]) for k, (name, aliases) in enumerate(characters)]
    return spark.createDataFrame(rows, "pos long, name string, aliases array<string>, chapters array<long>, personality string, voice_hint string, tags array<string>")


def _merged(spark, bible, new=(), told=(), said=()):
    """new: (name, aliases, personality, hint, tags); told: (owner, forms); said: speakers; all of chapter 7."""
    found = spark.createDataFrame([(k, 7, *x) for k, x in enumerate(new)], "at long, chapter long, name string, aliases array<string>, personality string, voice_hint string, tags array<string>")
    heard = spark.createDataFrame([(7, s) for s in said], "chapter long, speaker string")
    aliases = spark.createDataFrame([(100 + k, *x) for k, x in enumerate(told)], "at long, owner string, forms array<string>")
    return {r["name"]: r for r in resolve.upsert(bible, found, heard, aliases).collect()}


def test_merge_heals_and_keeps_what_is_known(spark):
    got = _merged(spark, _bible(spark), [("Lão Trần", [], "gruff", "elderly male", ["Old", "MALE", "old"])], said=["Lão Trần"])
    assert got["Lão Trần"].asDict() == {"name": "Lão Trần", "aliases": ["Lão Trần"], "chapters": [7], "first_seen": 7, "personality": "gruff", "voice_hint": "elderly male", "tags": ["old", "male"]}
    got = _merged(spark, _bible(spark), [("Hắn", ["y", "phàm nhân"], None, None, None)])
    assert got["Hắn"].aliases == ["Hắn"] and got["Hắn"].personality == "" and got["Hắn"].tags == []
    got = _merged(spark, _bible(spark, ("A", ["Tuyết"])), [("B", ["Tuyết"], "", "adult female", [])])
    assert got["A"].aliases == ["Tuyết"] and got["B"].aliases == ["B"]
    got = _merged(spark, _bible(spark, ("Huyền Vũ", ["Huyền Vũ"])), [("Huyền Vũ lão tổ", [], "y", "old man", ["old"])], said=["Huyền Vũ lão tổ"])
    assert list(got) == ["Huyền Vũ"] and got["Huyền Vũ"].aliases == ["Huyền Vũ", "Huyền Vũ lão tổ"] and got["Huyền Vũ"].chapters == [7]
    assert (got["Huyền Vũ"].personality, got["Huyền Vũ"].voice_hint, got["Huyền Vũ"].tags) == ("x", "adult male", ["male"])
    got = _merged(spark, _bible(spark, ("Mao Ý", ["Mao Ý"])), told=[("Mao Ý (thanh niên mặc hoa phục)", ["Mao Ý hoa phục"]), ("Ai Đó", ["Không"])])
    assert got["Mao Ý"].aliases == ["Mao Ý", "Mao Ý hoa phục"] and len(got) == 1
    got = _merged(spark, _bible(spark, ("Lạc Lan Tuyết", ["Lạc Lan Tuyết"])), told=[("Lạc Lan Tuyết", ["nữ tử", "Nữ tử", "cô gái", "tiền bối", "vị kia", "Lý cô nương"])])
    assert got["Lạc Lan Tuyết"].aliases == ["Lạc Lan Tuyết", "Lý cô nương"]
    got = _merged(spark, _bible(spark, ("Thanh Sơn lão tổ", ["Thanh Sơn lão tổ", "Sư phụ", "tiểu thư", "Lục Thanh Sơn"])), said=["Thanh Sơn lão tổ"])
    assert got["Thanh Sơn lão tổ"].aliases == ["Thanh Sơn lão tổ", "Lục Thanh Sơn"]


def test_scrub_is_idempotent_and_folds_bring_nothing_back(spark):
    bible = _bible(spark, ("Lạc Lan Tuyết", ["Lạc Lan Tuyết", "Nữ tử", "nữ tử", "cô gái", "nữ tử áo trắng", "Lý cô nương"]), ("Dịch Phong", ["Dịch Phong", "công tử", "tiền bối", "vị kia", "Dịch sư phụ"]), ("Quản gia", ["Quản gia"]), ("Lý Anh Liên", ["Lý Anh Liên", "lão tổ"]), ("Trần công tử", ["Trần công tử", "Trần Uy"]))
    once = resolve.scrubbed(bible)
    got = {r["name"]: (r.aliases, r.dropped) for r in once.collect()}
    assert got == {"Lạc Lan Tuyết": (["Lạc Lan Tuyết", "nữ tử áo trắng", "Lý cô nương"], 3), "Dịch Phong": (["Dịch Phong", "Dịch sư phụ"], 3), "Quản gia": (["Quản gia"], 0), "Lý Anh Liên": (["Lý Anh Liên"], 1), "Trần công tử": (["Trần công tử", "Trần Uy"], 0)}
    assert resolve.scrubbed(once).where("dropped > 0").count() == 0
    cast = _bible(spark, ("Thanh Sơn lão tổ", ["Thanh Sơn lão tổ", "Sư phụ", "sư tôn"]), ("Thanh Sơn", ["lão đầu", "Lục Thanh Sơn"]))
    folded = resolve.merge(cast, spark.createDataFrame([("Thanh Sơn lão tổ", "Thanh Sơn")], "survivor string, absorbed string")).first()
    assert folded.aliases == ["Thanh Sơn lão tổ", "Thanh Sơn", "Lục Thanh Sơn"]


def test_gaps_of_places_far_apart(spark):
    """Three places up to four thousand million: as many rows as there are gaps."""
    from taleweave.operators.timeline import gaps

    there = spark.createDataFrame([(1, 0), (1, 4_000_000_000), (1, 2), (1, 2), (2, 3), (3, 0)], "chapter long, pos long")
    assert sorted(tuple(r) for r in gaps(there).collect()) == [(1, 1, 1), (1, 3, 3_999_999_997), (2, 0, 3)]


def test_pool_joins_compare_sets_and_not_members(spark):
    """Sixty queries and ninety entries with few distinct sets: tags that nobody asks for make no new set, and what the sets
    give is what the pairs give."""
    from taleweave.operators import match

    tags = lambda k: ["red", f"own{k}", "blue" if k % 3 == 0 else "small"]
    asked = [(q, ["red", "large"] if q % 2 else ["small", "small", "blue"]) for q in range(60)]
    pool = [(i, tags(i)) for i in range(90)]
    a, p = spark.createDataFrame(asked, "q long, tags array<string>"), spark.createDataFrame(pool, "id long, tags array<string>")
    bar = [("small", "large"), ("red", "blue"), ("red", "green")]
    clash = lambda x, y: any((s in x and t in y) or (t in x and s in y) for s, t in bar)
    ok = [(q, i) for q, x in asked for i, y in pool if set(x) & set(y) and not clash(x, y)]
    assert match._set_pairs(*match._by_sets(a, p)).count() == 4
    assert sorted(tuple(r) for r in match.compatible(a, p, bar).collect()) == sorted(ok)
    assert sorted(tuple(r) for r in match.candidates(a, p, bar).collect()) == sorted({(q, sum(q == r for r, _ in ok), min(i for r, i in ok if r == q)) for q, _ in ok})
    assert {r["id"]: r["uses"] for r in match.reachable(a, p).collect()} == {i: [q for q, x in asked if set(x) & set(y)] for i, y in pool if any(set(x) & set(y) for _, x in asked)}
    _, best = match.best_by_set(a, p, match.F.floor(match.F.col("id") / 7))
    most = {q: max(len(set(x) & set(y)) for _, y in pool) for q, x in asked}
    want = [(q, i, most[q]) for q, x in asked for i, y in pool if len(set(x) & set(y)) == most[q]]
    got = match.best_overlap(a, p, match.F.floor(match.F.col("id") / 7)).collect()
    assert best.count() < len(got) and sorted((r.q, r.id, r.n) for r in got) == sorted(want)
    assert all(r.place == 1 + sum(q == r.q and i < r.id for q, i, _ in want) for r in got)


def test_release_hold_in_the_arithmetic_of_the_c_library(spark):
    """Bit for bit, and silence holds nothing instead of being unknown."""
    import math

    x = [0.0, 110.61, 3.3, 0.0, 162.37, 99.99, 171.91]
    got = sequential.release_hold(spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(x)], "chapter long, pos long, x double"), 0.9).orderBy("pos").collect()
    fall = [(k + 1) * math.log(0.9) for k in range(len(x))]
    logs = [(math.log(v) if v else -math.inf) - f for v, f in zip(x, fall, strict=True)]
    assert [r.hold for r in got] == [math.exp(max(logs[: k + 1]) + fall[k]) for k in range(len(x))]
    assert got[0].hold == 0.0
