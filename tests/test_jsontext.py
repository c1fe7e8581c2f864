"""Places of JSON members against the parser, and edits that leave the rest alone."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from taleweave.operators import jsontext

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


def loose(value, r):
    """JSON with spaces where they are allowed."""
    gap = lambda: r.choice(["", "", " ", "\n  ", "\t"])
    if isinstance(value, dict):
        return "{" + gap() + ",".join(gap() + json.dumps(k) + gap() + ":" + gap() + loose(v, r) + gap() for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + gap() + ",".join(gap() + loose(v, r) + gap() for v in value) + "]"
    return json.dumps(value, ensure_ascii=r.random() < 0.5)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.integers(0, 1 << 30))
def test_places_against_the_parser(value, seed):
    text = " " + loose(value, random.Random(seed)) + "\n"
    found = jsontext.scan(text)
    if isinstance(value, dict):
        assert [(k, json.loads(text[a:b])) for k, _, a, b in found] == list(value.items())
        assert all(text[at] == '"' for _, at, _, _ in found)
    elif isinstance(value, list):
        assert [json.loads(text[a:b]) for _, _, a, b in found] == value
    else:
        assert found is None


def test_broken_texts_are_refused():
    for text in ("", "x", "{", '{"a"', '{"a": }', '{"a" 1}', '{"a": 1', '{"a": 1,}', '{a: 1}', '{"a": [1}', '{"a": "b}', '{"a": 1 2}', "[1,", "[1 2]", "[,]", '{"a": 1;, "b"}x', '{"a":: 1}', "[1]]"[:2]):
        assert jsontext.scan(text) is None, text
    assert jsontext.scan("{}") == [] and jsontext.scan(" [ ] tail") == []


def test_edits_leave_the_rest_alone(spark):
    r, rows, edits, want = random.Random(7), [], [], {}
    for k in range(120):
        body = {f"k{j}": r.choice([1, "a, b}", [1, {"x": "]"}], None, {"y": {}}, "é\n"]) for j in range(r.randint(0, 6))}
        text = r.choice(["", " ", "\n"]) + loose(body, r) + r.choice(["", "\n", " // end"])
        rows.append((k, text))
        if k % 10 == 9:
            continue
        change = {f"k{j}": r.choice(["2", '"new"', '[1, 2]', None]) for j in r.sample(range(8), r.randint(1, 3))}
        edits += [(k, key, v) for key, v in change.items()]
        after = dict(body)
        for key, v in sorted(change.items()):
            if v is None:
                after.pop(key, None)
            else:
                after[key] = json.loads(v)
        want[k] = (after, change)
    rows += [(200, "not json"), (201, None), (202, '{"a": 1, "a": 2}')]
    edits += [(200, "a", "1"), (201, "a", "1"), (202, "a", "3")]
    found = jsontext.members(spark.createDataFrame(rows, "id long, text string"))
    got = {x.id: x.text for x in jsontext.edited(found, spark.createDataFrame(edits, "id long, key string, value string")).collect()}
    texts = dict(rows)
    assert got[200] == "not json" and got[201] is None and got[202] == '{"a": 1, "a": 3}'
    for k, text in texts.items():
        if k >= 200:
            continue
        if k not in want:
            assert got[k] == text
            continue
        after, change = want[k]
        new = jsontext.scan(got[k])
        assert new is not None, (text, change, got[k])
        assert [(key, json.loads(got[k][a:b])) for key, _, a, b in new] == list(after.items()), (text, change, got[k])
        old = {key: text[at:b] for key, at, _, b in jsontext.scan(text)}
        for key, at, _, b in new:  # untouched members as they were, to the letter
            if key not in change:
                assert got[k][at:b] == old[key]
        if not any(v is None and key in old for key, v in change.items()) and set(change) <= set(old):
            a, b = text, got[k]  # and with replacements alone, everything between them
            for key, v in change.items():
                (s, e), (s2, e2) = next(x[2:] for x in jsontext.scan(a) if x[0] == key), next(x[2:] for x in jsontext.scan(b) if x[0] == key)
                a, b = a[:s] + a[e:], b[:s2] + b[e2:]
                a, b = a[:s] + "0" + a[s:], b[:s2] + "0" + b[s2:]
            assert a == b
