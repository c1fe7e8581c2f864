"""CSS selectors over the numbered elements of pages.

A selector is a list of chains; a chain is compounds joined by combinators. A compound is a condition on an element's own
columns. Combinators are windows and one equality join over the numbers of the elements, never pairs of elements:

    a b    the greatest `last` of the a's before b in its page reaches b
    a > b  b's parent is an a
    a + b  the element before b under its parent, which nth tells, is an a
    a ~ b  some element before b under its parent is an a

A page's elements come from one row, which bounds a window. Understood: tag, *, #id, .class, [a], [a=v] and the operators
~= |= ^= $= *= with the flag i; :first-child :last-child :only-child :nth-child() :nth-last-child() and the same of-type,
:empty, :root, :not(compounds), :is(compounds). A bracket or parenthesis that is not closed ends with the selector.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Condition = Callable[[], Column]
NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""(?P<tag>\*|{NAME}) | \#(?P<id>{NAME}) | \.(?P<class>{NAME})
    | \[\s*(?P<attr>{NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"[^"]*"?|'[^']*'?|[^\s\]]+)\s*(?P<flag>[is])?\s*)?(?:\]|$)
    | :(?P<pseudo>[\w-]+)""",
    re.X | re.S,
)
_COMBINED = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)
SPACE = r"[ \t\n\r\f]+"


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Column:
    own = F.element_at("attrs", F.lit(name.lower()))
    if op is None:
        return own.isNotNull()
    if fold:
        own, value = F.lower(own), value.lower()
    if op == "=":
        return own == value
    if op == "|=":
        return (own == value) | own.startswith(value + "-")
    if value == "" or op == "~=" and re.search(SPACE, value):
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(own, SPACE), value)
    return {"^=": own.startswith, "$=": own.endswith, "*=": own.contains}[op](value)


def _nth(place: Column, text: str) -> Column:
    """place is an + b for a whole n >= 0."""
    m = _NTH.fullmatch(text)
    if not m:
        raise ValueError(f"not a step: {text!r}")
    if m[1]:
        a, b = 2, 1 if m[1].lower() == "odd" else 0
    elif m[5]:
        a, b = 0, int(m[5])
    else:
        a, b = int(m[2] + "1" if m[2] in ("", "+", "-") else m[2]), int((m[3] or "+") + (m[4] or "0"))
    return place == b if a == 0 else (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place >= b) if a > 0 else (place <= b))


def _pseudo(name: str, inside: str | None) -> Column:
    place = {"child": ("nth", "after"), "of-type": ("nth_type", "after_type")}
    if inside is not None and name in ("not", "is", "where", "matches"):
        any_of = reduce(lambda a, b: a | b, [_single(c) for c in compiled(inside)])
        return ~any_of if name == "not" else any_of
    if name == "empty":
        return (F.col("last") == F.col("pos")) & (F.col("text_at") == F.col("text_end"))
    if name == "root":
        return F.col("parent") == -1
    for kind, (before, behind) in place.items():
        first, last = F.col(before), F.col(behind) + 1
        if name in (f"first-{kind}", f"last-{kind}", f"only-{kind}"):
            return {"f": first == 1, "l": last == 1, "o": (first == 1) & (last == 1)}[name[0]]
        if inside is not None and name in (f"nth-{kind}", f"nth-last-{kind}"):
            return _nth(last if "last" in name else first, inside)
    raise ValueError(f"unknown condition :{name}")


def _single(chain: list[tuple[str, Column]]) -> Column:
    if len(chain) != 1:
        raise ValueError("only compounds stand inside :not() and :is()")
    return chain[0][1]


def _closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one before `at`, or the end."""
    depth, quote = 1, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                return k
    return len(text)


def compiled(selector: str) -> list[list[tuple[str, Column]]]:
    """Chains of (combinator, condition); the first combinator of a chain is ''."""
    chains, chain, now, at, joined = [], [], [], 0, ""
    text = selector.strip()

    def shut() -> None:
        if not now:
            raise ValueError(f"not a selector: {selector!r}")
        chain.append((joined, reduce(lambda a, b: a & b, now)))
        now.clear()

    while at < len(text):
        if m := re.compile(r"\s*,\s*").match(text, at):
            shut()
            chains.append(chain)
            chain, joined = [], ""
        elif now and (m := _COMBINED.match(text, at)):
            shut()
            joined = m[1] or " "
        elif m := _PART.match(text, at):
            end = m.end()
            if m["tag"]:
                if now:
                    raise ValueError(f"not a selector: {selector!r}")
                now.append(F.lit(True) if m["tag"] == "*" else F.col("tag") == _plain(m["tag"]).lower())
            elif m["id"] or m["class"]:
                now.append(F.coalesce(_attribute("id", "=", _plain(m["id"]), False) if m["id"] else _attribute("class", "~=", _plain(m["class"]), False), F.lit(False)))
            elif m["attr"]:
                value = m["value"] or ""
                value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else _plain(value)
                now.append(F.coalesce(_attribute(_plain(m["attr"]), m["op"], value, (m["flag"] or "").lower() == "i"), F.lit(False)))
            else:
                inside = None
                if text[end : end + 1] == "(":
                    stop = _closing(text, end + 1)
                    inside, end = text[end + 1 : stop], stop + 1
                now.append(_pseudo(m["pseudo"].lower(), inside))
            at = end
            continue
        else:
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
    shut()
    return [*chains, chain]


def _follow(found: DataFrame, joined: str, condition: Column) -> DataFrame:
    """found with hit: whether the element meets the condition and its counterpart in found was a hit."""
    page, siblings = W.partitionBy("page_id").orderBy("pos"), W.partitionBy("page_id", "parent").orderBy("pos")
    if joined == " ":
        reach = F.max(F.when(F.col("hit"), F.col("last"))).over(page.rowsBetween(W.unboundedPreceding, -1))
        near = reach >= F.col("pos")
    elif joined == "+":
        near = F.lag(F.when(F.col("hit"), F.col("nth"))).over(siblings) == F.col("nth") - 1
    elif joined == "~":
        near = F.max("hit").over(siblings.rowsBetween(W.unboundedPreceding, -1))
    else:
        above = found.where("hit").select("page_id", F.col("pos").alias("parent"), F.lit(True).alias("under"))
        found, near = found.join(above, ["page_id", "parent"], "left"), F.col("under")
    return found.withColumn("hit", F.coalesce(near, F.lit(False)) & condition).drop("under")


def matched(found: DataFrame, selector: str) -> DataFrame:
    """The rows of found (as pages.elements() gives them) that the selector selects, each once. Columns named hit or under
    are not kept. Only elements that meet one of a chain's conditions are shuffled, with what they meet instead of what it
    is read from."""
    columns = [c for c in found.columns if c not in ("hit", "under")]
    hits = []
    for chain in compiled(selector):
        meets = [c.alias(f"__meets{k}") for k, (_, c) in enumerate(chain)]
        marked = found.where(reduce(lambda a, b: a | b, [c for _, c in chain])).select(*columns, *meets).withColumn("hit", F.col("__meets0"))
        for k, (joined, _) in enumerate(chain[1:], 1):
            marked = _follow(marked, joined, F.col(f"__meets{k}"))
        hits.append(marked.where("hit").select(*columns))
    return hits[0] if len(hits) == 1 else reduce(DataFrame.unionByName, hits).dropDuplicates(["page_id", "pos"])


def first_text(read: DataFrame, selector: str) -> DataFrame:
    """page_id, text: of the first match in each parsed() page, squeezed; '' without one."""
    from taleweave.operators import pages

    first = pages.firsts(matched(pages.elements(read), selector))
    text = pages.contents(first, read).select("page_id", "text")
    return read.select("page_id").join(text, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))


def first_prose(read: DataFrame, selector: str) -> DataFrame:
    """page_id, text: of the first match in each parsed() page with its paragraphs; '' without one."""
    from taleweave.functions import markup
    from taleweave.operators import pages

    first = pages.firsts(matched(pages.elements(read), selector))
    text = pages.contents(first, read).select("page_id", markup.prose(markup.text_of(F.col("html"))).alias("text"))
    return read.select("page_id").join(text, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))
