import math
import re
from collections import Counter

import pytest

from taleweave.llm import licences
from tests.llm.helpers import empty

HEADER = "Licensed under the Apache License, Version 2.0."


def brute(text, name):
    """Cosines of every passage with every template, written out."""
    find = lambda t: re.findall(r"[0-9a-zà-ɏ](?:[0-9a-zà-ɏ.-]*[0-9a-zà-ɏ])?", t.lower())
    templates = [(n, Counter(find(t))) for n in sorted(licences.TEMPLATES) for t in licences.TEMPLATES[n]]
    df = Counter(w for _, tf in templates for w in tf)
    idf = lambda w: math.log((1 + len(templates)) / (1 + df[w])) + 1
    vector = lambda tf: {w: n * idf(w) for w, n in tf.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    passages = text.split("\n") + re.split(r"\n\s*\n", text) + ([text] if re.match(licences.LICENCE_FILE, name) else [])
    best = []
    for p in passages:
        v = vector(Counter(find(p)))
        for n, tf in templates:
            t = vector(tf)
            if v:
                best.append((round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 9), n))
    good = [(-c, n) for c, n in best if c >= licences.THRESHOLD]
    return min(good)[1] if good else None


def test_matches_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "concat('d/', doc_id) path", "text")
    for r in licences.own_licences(docs, ("doc_id",)).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.own == brute(r.text, str(r.doc_id))
    texts = [HEADER, "# " + HEADER.upper() + "\nx = 1", "released under\nthe MIT license\n\nmore text here", "the the the", "Licensed under CC BY 4.0. and CC BY-NC 4.0.", "GNU General Public License version 3 or the like"]
    files = spark.createDataFrame([(f"p{k}/{n}", t) for k, t in enumerate(texts) for n in ("COPYING", "a.py")], "path string, text string")
    for r in licences.own_licences(files, ()).join(files, "path").collect():
        assert r.own == brute(r.text, r.path.split("/")[1]), r.path


def test_nearest_ancestor(spark):
    rows = [
        ("LICENSE", HEADER), ("a/LICENSE.md", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/NOTICE", "Licensed under CC BY 4.0."), ("a/b/c/y.py", "code"),
        ("z/y.py", "code"), ("z/own.py", "This work is licensed under the GNU General Public License, version 3."), ("licence_notes/q", None), (None, "code"), ("a/b/x.py", "code"), ("lic.py", ""),
    ]
    got = licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert len(got) == len(rows)
    found = {r.path: (r.licence, r.from_directory) for r in got}
    assert found["a/b/x.py"] == ("MIT", "a") and found["a/b/c/y.py"] == ("CC-BY-4.0", "a/b/c") and found["z/y.py"] == ("Apache-2.0", "")
    assert found["z/own.py"] == ("GPL-3.0", None) and found["licence_notes/q"] == ("Apache-2.0", "") and found[None] == (None, None) and found["lic.py"] == ("Apache-2.0", "")


@pytest.mark.parametrize("hot", [1, 512])
def test_inheritance_against_walking_up(spark, monkeypatch, hot):
    monkeypatch.setattr(licences, "HOT", hot)
    directories = [f"a{k % 3}/b{k % 7}/c{k}" for k in range(60)] + ["", "z", "a0", "/rooted/x", "a1//b"]
    owners = {"a0": "MIT", "a1/b4": "ISC", "a2/b2/c2": "Zlib", "a2": "BSD-2-Clause", "a0/b3": "Apache-2.0"}
    for own in (owners, owners | {"": "MPL-2.0"}):
        given = spark.createDataFrame([(d,) for d in directories], "directory string")
        licensed = spark.createDataFrame(list(own.items()), "directory string, licence string")
        want = set()
        for d in directories:
            parts = [x for x in d.split("/") if x]
            above = next((x for x in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if x in own), None)
            if above is not None:
                want.add((d, above, own[above]))
        got = licences.inherited(given, licensed).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cases(spark):
    from pyspark.sql import functions as F

    assert licences.scan(empty(spark).withColumn("path", F.lit("x")), ("doc_id",)).count() == 0
    rows = [("d/LICENSE", HEADER), ("d/e/f", "w " * 50_000)]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("x") for c in ("own", "cosine", "directory", "licence", "salt", "depth")})
    assert {r.path: r.licence for r in licences.scan(df).collect()} == {"d/LICENSE": "Apache-2.0", "d/e/f": "Apache-2.0"}


def test_ties_take_the_smaller_name(spark):
    same = {"B": ("alpha beta gamma",), "A": ("alpha beta gamma",)}
    files = spark.createDataFrame([("f", "alpha beta gamma")], "path string, text string")
    r = licences.own_licences(files, (), same).first()
    assert r.own == "A" and r.cosine == pytest.approx(1.0)


def test_neighbouring_licences_keep_their_own_names():
    matcher = licences.Matcher(licences.TEMPLATES, licences.THRESHOLD)
    name = lambda text: (matcher.best(text, True) or (0, None))[1]
    for own, texts in licences.TEMPLATES.items():
        assert {name(t) for t in texts} == {own}
    assert name("GNU Affero General Public License, version 3") in ("AGPL-3.0", None)
    assert name("GNU General Public License, version 2") in ("GPL-2.0", None)
    assert name("This work is licensed under the GNU General Public License, version 1.") is None
    assert name("Licensed under CC BY-NC-SA 4.0.") is None
    two = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:"
    assert name(two) == "BSD-2-Clause" and name(two + "\n\n3. Neither the name of the holder\nnor of its contributors") == "BSD-3-Clause"
