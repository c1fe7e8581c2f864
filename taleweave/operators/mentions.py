"""Surface forms of names in chapter texts, and what a chapter's attribution says about them.

A cast grows with the data, so no list of names goes to every task. A form of one word is keyed by it, a longer one by the
pair of neighbouring words in it that the fewest chapters hold, and chapters meet the forms keyed by their own distinct words
and pairs. Words are few and forms many, so by single words each chapter would meet more forms as the cast grows. Each
chapter is then read once by an automaton over its own candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.functions.text import descriptive, stopped
from taleweave.operators.resolve import resolve
from taleweave.operators.slices import slices
from taleweave.scratch import written

WORD = r"([\p{L}\p{N}]+)"
TOKEN = re.compile(r"[^\W_]+|[\W_]+")
ANONYMOUS, NARRATOR = "Anonymous", "Narrator"


def words(text: Column) -> Column:
    """Runs of letters and digits in order."""
    return F.regexp_extract_all(text, F.lit(WORD))


def neighbours(words: Column) -> Column:
    """Pairs of words that follow one another."""
    return F.array_compact(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))


def anonymous(name: Column) -> Column:
    return (name == ANONYMOUS) | name.rlike(r"^anonymous:anon-\+?[0-9]+$")


def scan(text: str, forms: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, form) of the forms that stand in a text between other characters than letters and digits: from left to
    right, the longest at each place, none over another. The forms make one automaton over words and what is between
    words, so a step of it is a word; forms that begin or end with another character need one over characters."""
    if any(not (f[0].isalnum() and f[-1].isalnum()) for f in forms):
        return _by_characters(text, forms)
    start: dict = {}
    for f in forms:
        state = start
        for t in TOKEN.findall(f):
            state = state.setdefault(t, {})
        state[None] = f
    tokens, out, free = TOKEN.findall(text), [], 0
    begun = [k for k, t in enumerate(tokens) if t in start]
    places = [0, *accumulate(map(len, tokens))] if begun else []
    for k in begun:
        if k < free:
            continue
        state, j, end, best = start[tokens[k]], k, k, None
        while state is not None:
            j += 1
            if None in state:
                end, best = j, state[None]
            state = state.get(tokens[j]) if j < len(tokens) else None
        if best is not None:
            out.append((places[k], places[k] + len(best), best))
            free = end
    return out


def _by_characters(text: str, forms: list[str]) -> list[tuple[int, int, str]]:
    machine = ahocorasick.Automaton()
    for f in forms:
        machine.add_word(f, f)
    machine.make_automaton()
    longest: dict[int, int] = {}
    for last, f in machine.iter(text):
        start = last + 1 - len(f)
        if not text[start - 1 : start].isalnum() and not text[last + 1 : last + 2].isalnum() and last + 1 > longest.get(start, 0):
            longest[start] = last + 1
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            free = longest[start]
            out.append((start, free, text[start:free]))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        at, names, times, first = [], [], [], []
        for k, (text, forms) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            seen: dict[str, list[int]] = {}
            for start, _, form in scan(text, forms):
                seen.setdefault(form, []).append(start)
            for form, starts in seen.items():
                at.append(k)
                names.append(form)
                times.append(len(starts))
                first.append(starts[0])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], names=["chapter", "form", "times", "first"])


def candidates(chapters: DataFrame, forms: DataFrame) -> DataFrame:
    """chapter, text and the forms that it may hold: those of whose keys it holds the rarest."""
    each = forms.select("form").distinct().withColumn("words", words(F.col("form")))
    key = F.array_distinct(F.when(F.size("words") > 1, neighbours(F.col("words"))).otherwise(F.col("words")))
    each = written(each.select("form", key.alias("keys")).where(F.size("keys") > 0), "forms")
    asked = each.select(F.explode("keys").alias("key")).distinct()
    every = chapters.select("chapter", words(F.col("text")).alias("words"))
    every = every.select("chapter", F.explode(F.array_union("words", neighbours(F.col("words")))).alias("key"))
    held = written(every.join(asked, "key", "left_semi"), "keys-held")
    spread = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = each.select("form", F.size("keys").alias("keys"), F.explode("keys").alias("key")).join(spread, "key")
    keyed = known.groupBy("form").agg(F.count(F.lit(1)).alias("known"), F.min_by("key", F.struct("n", "key")).alias("key"), F.first("keys").alias("keys"))
    keyed = keyed.where("known = keys").select("key", "form")  # all that it is made of occurs somewhere
    met = held.join(keyed, "key").groupBy("chapter").agg(F.collect_list("form").alias("forms"))
    return chapters.select("chapter", "text").join(met, "chapter").select("chapter", "text", "forms")


def found(chapters: DataFrame, forms: DataFrame) -> DataFrame:
    """chapter, form, times and first (characters before it) of the forms in each chapter's text, as scan() has them.
    chapters: chapter (unique), text; forms: form. Forms without a letter or digit are not looked for."""
    kind = chapters.schema["chapter"].dataType.simpleString()
    return candidates(chapters, forms).mapInArrow(_read, f"chapter {kind}, form string, times long, first long")


def owned(claims: DataFrame) -> DataFrame:
    """form, owner of the forms that one owner alone claims, without forms that only describe or that the scene decides.
    claims: form, owner."""
    usable = claims.select(F.trim("form").alias("form"), F.trim("owner").alias("owner")).where((F.col("form") != "") & (F.col("owner") != ""))
    usable = usable.where(~stopped(F.col("form")) & ~descriptive(F.col("form")))
    one = usable.groupBy("form").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return one.where("owner = other").select("form", "owner")


def mentions(chapters: DataFrame, claims: DataFrame) -> DataFrame:
    """chapter, form, owner, times and first of every form of one owner that a chapter's text holds."""
    forms = written(owned(claims), "owned-forms")
    return found(chapters, forms).join(forms, "form").select("chapter", "form", "owner", "times", "first")


def _supported(chapters: DataFrame, asked: DataFrame, bible: DataFrame, told: DataFrame) -> DataFrame:
    """asked (chapter, name) with named and described: whether the chapter's text holds the name, a form that bears it, or a
    form that describes it, in any case. told: chapter, form, owner of the chapter's own answer."""
    aliases = bible.select("name", F.explode("aliases").alias("form")).where(F.trim("form") != "")
    bears = ~stopped(F.col("form")) & ~descriptive(F.col("form"))
    stated = asked.select("chapter", "name", F.col("name").alias("form"), F.lit(True).alias("bears"))
    held = asked.join(aliases, "name").select("chapter", "name", "form", bears.alias("bears"))
    answered = asked.join(told.select("chapter", F.col("owner").alias("name"), "form"), ["chapter", "name"]).where(bears).select("chapter", "name", "form", F.lit(True))
    every = stated.unionByName(held.where("bears").unionByName(held.where(descriptive(F.col("form"))).select("chapter", "name", "form", F.lit(False).alias("bears")))).union(answered)
    every = every.withColumn("form", F.lower(F.trim("form"))).where("form <> ''").distinct()
    hits = found(chapters.select("chapter", F.lower("text").alias("text")), every.select("form")).select("chapter", "form")
    met = every.join(hits, ["chapter", "form"]).groupBy("chapter", "name").agg(F.max("bears").alias("named"), F.max(~F.col("bears")).alias("described"))
    no = F.lit(False)
    return asked.join(met, ["chapter", "name"], "left").select("chapter", "name", F.coalesce("named", no).alias("named"), F.coalesce("described", no).alias("described"))


def described_only(chapters: DataFrame, roster: DataFrame, speakers: DataFrame, told: DataFrame, bible: DataFrame) -> DataFrame:
    """chapter, name of the figures that a chapter describes and never names, under the name given and the one it resolves to.
    roster: chapter, name; speakers: chapter, speaker; told: chapter, form, owner; bible: pos, name, aliases."""
    given = roster.select("chapter", F.trim("name").alias("speaker"), F.lit(False).alias("epithet"))
    given = given.unionByName(speakers.select("chapter", F.trim("speaker").alias("speaker"), F.lit(False).alias("epithet")))
    given = given.unionByName(told.where(descriptive(F.col("form"))).select("chapter", F.trim("owner").alias("speaker"), F.lit(True).alias("epithet")))
    given = given.groupBy("chapter", "speaker").agg(F.max("epithet").alias("epithet")).where((F.col("speaker") != "") & (F.col("speaker") != NARRATOR) & ~anonymous(F.col("speaker")))
    given = written(resolve(given, bible).where((F.col("resolved") != NARRATOR) & ~anonymous(F.col("resolved"))), "figures")
    known = _supported(chapters, given.select("chapter", F.col("resolved").alias("name")).distinct(), bible, told)
    unnamed = given.join(known.withColumnRenamed("name", "resolved"), ["chapter", "resolved"]).where("not named and (epithet or described)")
    return unnamed.select("chapter", F.explode(F.array("speaker", "resolved")).alias("name")).distinct()


def attribution(chapters: DataFrame, roster: DataFrame, speakers: DataFrame, told: DataFrame, newcomers: DataFrame, bible: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A chapter's answer made fit for the bible: roster (chapter, pos, name), speakers (chapter, id, speaker), mentions
    (chapter, form, owner) and newcomers (chapter, name: named nowhere else, to be taken up without a description).

    roster: chapter, pos, name; speakers: chapter, id, speaker; told: chapter, form, owner; newcomers: chapter, name of the
    characters that the answer describes; bible: pos, name, aliases. Figures that a chapter only describes leave the roster
    and the mentions and speak as the anonymous one; an anonymous roster entry stays if a line has it. A mention stays if its
    form stands in the text, bears a name, and its owner is the narrator, in the roster or known."""
    unnamed = written(described_only(chapters, roster, speakers, told, bible), "described-only")
    named = roster.select("chapter", "pos", F.trim("name").alias("name")).where("name <> ''").join(unnamed, ["chapter", "name"], "left_anti")
    speaking = speakers.select("chapter", F.col("speaker").alias("name")).distinct().withColumn("speaks", F.lit(True))
    cast = named.join(speaking, ["chapter", "name"], "left").where(~anonymous(F.col("name")) | F.col("speaks")).groupBy("chapter", "name").agg(F.min("pos").alias("pos"))
    cast = written(cast, "named-cast")

    heard = resolve(speakers.select("chapter", "id", F.trim("speaker").alias("speaker")), bible)
    silent = unnamed.withColumn("unnamed", F.lit(True))
    heard = heard.join(silent.withColumnRenamed("name", "speaker"), ["chapter", "speaker"], "left").withColumnRenamed("unnamed", "a")
    heard = heard.join(silent.withColumnRenamed("name", "resolved"), ["chapter", "resolved"], "left")
    lines = heard.select("chapter", "id", F.when(F.coalesce("a", "unnamed"), ANONYMOUS).otherwise(F.col("speaker")).alias("speaker"))

    described = newcomers.select("chapter", F.trim("name").alias("name")).where("name <> ''").join(unnamed, ["chapter", "name"], "left_anti").distinct()
    at_home = bible.select("name").distinct().withColumn("home", F.lit(True))

    def known(rows: DataFrame, name: str) -> DataFrame:
        """rows with `known`: a character of the bible, or someone that resolves to one."""
        met = resolve(rows.withColumn("speaker", F.col(name)), bible).join(at_home.withColumnRenamed("name", "speaker"), "speaker", "left")
        return met.withColumn("known", F.coalesce("home", F.lit(False)) | (F.col("resolved") != F.col("speaker"))).drop("speaker", "resolved", "home")

    alone = known(cast.where((F.col("name") != NARRATOR) & ~anonymous(F.col("name"))), "name").where("not known").select("chapter", "name").join(described, ["chapter", "name"], "left_anti")

    of = told.select("chapter", F.trim("form").alias("form"), F.trim("owner").alias("owner")).where("form <> ''").where(~stopped(F.col("form")) & ~descriptive(F.col("form")))
    of = of.join(unnamed.withColumnRenamed("name", "owner"), ["chapter", "owner"], "left_anti")
    here = cast.select("chapter", F.col("name").alias("owner")).union(described).distinct().withColumn("here", F.lit(True))
    of = known(of.join(here, ["chapter", "owner"], "left"), "owner").where((F.col("owner") == NARRATOR) | F.col("here") | F.col("known"))
    kept = of.select("chapter", "form", "owner").join(found(chapters, of.select("form")).select("chapter", "form"), ["chapter", "form"]).distinct()
    return cast.select("chapter", "pos", "name"), lines, kept, alone
