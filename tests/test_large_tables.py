"""What only larger tables bring: odd rows, full batches, frequent words and long logs, made small."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taleweave import registry
from taleweave.operators import mentions, pages, selectors, sequential, slices, speech
from taleweave.streaming import live


def against_sql(spark, folder, name):
    """(rows that the query has and its SQL has not, the other way) over the tables in folder."""
    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = {tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*columns).collect()}
    want = set(want.fetchall())
    return got - want, want - got


def save(frame, folder, name):
    frame.toPandas().to_parquet(folder / f"{name}.parquet")


def test_a_number_alone_with_a_cue_is_not_judged(spark, tmp_path):
    texts = [(1, "4272428119881650 and more", 90), (2, "+1", 24), (3, "word", 90), (4, "7", 91), (5, "4272", 78)]
    save(spark.createDataFrame(texts, "doc_id long, text string, n_chars long"), tmp_path, "documents")
    vectors = spark.range(1, 6).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (k % 16 / 16).cast("float")).alias("embedding"))
    save(vectors, tmp_path, "embeddings")
    assert against_sql(spark, tmp_path, "v19_babble_verdict") == (set(), set())


def test_slices_hold_every_row_once_in_order():
    texts = ["x" * n for n in (5, 0, slices.BYTES + 1, 7)] + [None] * 600 + ["y" * (slices.BYTES // 3)] * 7
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t, pa.string())], names=["id", "text"]) for t in (texts, [], texts[:1])]
    got = list(slices.slices(iter(batches), 1))
    assert [r for b in got for r in b.column(1).to_pylist()] == texts + texts[:1]
    assert all(b.num_rows <= slices.ROWS and (b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= slices.BYTES) for b in got)


@pytest.mark.parametrize(("task", "rest"), [(pages._parse, []), (sequential._split, []), (mentions._read, [pa.array([["words"]] * 2_000)])])
def test_a_task_hands_out_its_rows_before_it_has_read_a_batch(task, rest):
    texts = ["<p>Some words.</p> \"One\"\n" * 40] * 2_000
    columns = [pa.array(range(2_000), pa.int64()), pa.array(texts), *rest]
    given = list(task(iter([pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "forms"][: len(columns)])])))
    assert len(given) >= 8 and sum(b.nbytes for b in given) > 4 * max(b.nbytes for b in given)
    assert pa.Table.from_batches(given).column(0).unique().to_pylist() == list(range(2_000))


def test_json_is_repaired_in_slices():
    import pandas as pd

    given = list(speech.repaired_json.func(iter([pd.Series(["{} "] * 1_000)])))
    assert [len(s) for s in given] == [256, 256, 256, 232] and {x for s in given for x in s} == {"{}"}


def test_chapters_meet_forms_by_pairs_of_words(spark):
    """Each chapter holds all words of all forms, but the pairs of its own forms only."""
    words = [f"w{k}" for k in range(12)]
    forms = [f"{a} {b}" for a in words for b in words]
    rows = [(k, " ".join(words[k:] + words[:k])) for k in range(12)]
    met = mentions.candidates(spark.createDataFrame(rows, "chapter long, text string"), spark.createDataFrame([(f,) for f in forms], "form string"))
    assert {r.chapter: len(r.forms) for r in met.collect()} == {k: 11 for k, _ in rows}


def test_a_chain_shuffles_only_what_meets_its_conditions(spark):
    """Elements that meet no condition of a chain go into no window; a sibling that stands further off is not the one before."""
    html = "<ul><li class='a'>1</li>" + "<li><b>x</b></li>" * 50 + "<li class='c'>2</li><li class='a'>3</li><li class='c'>4</li></ul>"
    found = pages.elements(pages.parsed(spark.createDataFrame([(1, html)], "page_id long, html string")))
    near = selectors.matched(found, "li.a + li.c")
    assert [r.pos for r in near.collect()] == [104]
    assert [r.pos for r in selectors.matched(found, "li.a ~ li.c").orderBy("pos").collect()] == [102, 104]
    below = near._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert any("Filter" in line and "= li" in line for line in below.splitlines())


def test_edits_scan_each_text_once(spark, data):
    plan = registry.queries()["s37_json_edits"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_worker_hands_out_its_changes_at_once():
    import pandas as pd

    class Kept:
        get = lambda self: None
        update = lambda self, value: None

    worker = live.Liveness(1_000)
    worker.last, worker.handle = Kept(), type("Handle", (), {"registerTimer": lambda self, ms: None})()
    (given,) = worker.handleInputRows((7,), iter([pd.DataFrame({"ms": [5_000, 0]}), pd.DataFrame({"ms": [500]})]), None)
    assert [tuple(r) for r in given.itertuples(index=False)] == [(7, "online", 0), (7, "offline", 1_500), (7, "online", 5_000)]


@pytest.mark.parametrize("name", ["a16_bible_merge", "a16_bible_healing"])
def test_a_merge_reads_its_finds_once_for_people_and_once_for_claims(spark, data, name):
    """Both are written, so that only the speakers are still read from the orders by the last plan."""
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "o_custkey" in line for line in plan.splitlines()) == 1


def test_a_find_comes_before_an_alias_told_in_its_place(spark):
    from taleweave.operators import resolve

    cast = spark.createDataFrame([(0, "Zo", [], [])], "pos long, name string, aliases array<string>, chapters array<long>")
    found = spark.createDataFrame([(5, 1, "Zo lão tổ", ["Zed"])], "at long, chapter long, name string, aliases array<string>")
    told = spark.createDataFrame([(5, "ZO", ["Ann", "Bo"])], "at long, owner string, forms array<string>")
    said = spark.createDataFrame([], "chapter long, speaker string")
    (row,) = resolve.upsert(cast, found, said, told).collect()
    assert row.aliases == ["Zo lão tổ", "Ann", "Zed", "Bo"]


def test_odd_names_have_the_keys_that_the_patterns_give(spark):
    import re

    from taleweave.functions import text as tx

    space, titles = "[ \t\n\r\f\x0b]", "|".join(tx.TITLE_SUFFIXES)

    def key(name):
        s = re.sub(r"\([^(]*\)\Z", "", re.sub(f"{space}+", " ", name).strip(" ")).strip(" ").lower().strip(" ")
        return re.sub(rf"^(.*?[^ ]) *(?:(?:{titles}) *)+\Z", r"\1", s).strip(" ")

    parts = ["", " ", "\t", "A", "\x0bB  C", "(young)", "( old ) ", ")", "lão tổ", "SƯ PHỤ", "sư huynh\n", "xsư tỷ", "lão\ttổ", "y", " Hắn ", "tổ"]
    names = [a + sep + b + end for a in parts for b in parts for sep in ("", " ", "\r\n") for end in ("", " lão tổ", " sư tỷ  (x)")]
    got = spark.createDataFrame([(n,) for n in [*names, None]], "name string").select("name", tx.canon_key(F.col("name")).alias("key"), tx.stopped(F.col("name")).alias("stopped")).collect()
    stop = {*tx.ALIAS_STOP, *tx.TITLE_SUFFIXES}
    assert {r.name: (r.key, r.stopped) for r in got} == {n: (key(n), re.sub(rf"^{space}+|{space}+\Z", "", n).lower() in stop) for n in names} | {None: (None, None)}


@pytest.mark.parametrize("name", ["a16_bible_merge", "a16_bible_healing"])
def test_a_merge_keys_each_speaker_once(spark, data, name):
    """No filter for nulls asks for the key again below the count of speakers."""
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]


def test_a_speaker_without_a_name_is_no_character(spark):
    from taleweave.operators import resolve

    cast = spark.createDataFrame([(0, "(x)", [], [1]), (1, "Zo", [], [])], "pos long, name string, aliases array<string>, chapters array<long>")
    found = spark.createDataFrame([], "at long, chapter long, name string, aliases array<string>")
    said = spark.createDataFrame([(2, None), (3, "ZO"), (4, "(y)")], "chapter long, speaker string")
    assert {r["name"]: r.chapters for r in resolve.upsert(cast, found, said).collect()} == {"(x)": [1, 4], "Zo": [3]}


def test_places_of_claims_are_numbers_in_their_order(spark):
    from decimal import Decimal

    from taleweave.operators import resolve

    places = [(t, at, k, told) for t in (0, 1) for at in (-(2**63), -1, 0, 5, 2**63 - 1) for k in (0, 1, 2**31 - 1) for told in (0, 1)]
    rank = resolve._place(F.col("turn"), F.col("at"), F.col("k"), F.col("told"))
    rows = spark.createDataFrame(places, "turn int, at long, k int, told int").withColumn("rank", rank)
    got = rows.collect()
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.rank)] == sorted(places) and len({r.rank for r in got}) == len(places)
    assert all((r.rank < Decimal(2**96)) == (r.turn == 0) for r in got)
    plan = rows.groupBy("k").agg(F.min("rank"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_line_separator_inside_a_name_does_not_keep_its_title(spark):
    from taleweave.functions import text as tx

    names = {"A B lão tổ": "a b", "A\x85B sư tỷ  (x)": "a\x85b", "(a) b (c": "(a) b (c", "A (b) (c(d)": "a (b) (c", ")": ")", "()": ""}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", tx.canon_key(F.col("name")).alias("key")).collect()
    assert {r["name"]: r.key for r in got} == names


@pytest.fixture
def many_of_a_set(spark):
    """3,000 queries and 700 entries of one set of tags, and one entry that shares nothing with a query."""
    queries = spark.range(3_000).select(F.col("id").alias("q"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    held = spark.range(701).select("id", F.when(F.col("id") < 700, F.array(F.lit("a"))).otherwise(F.array(F.lit("z"))).alias("tags"))
    return queries, held


def test_pairs_are_unpacked_behind_a_shuffle_of_packs(spark, many_of_a_set):
    """All pairs come out, in blocks of at most PACK by PACK, and no join hands pairs on."""
    from taleweave.operators import match

    queries, held = many_of_a_set
    for pairs in (match.compatible(queries, held, [("a", "x")]), match.best_overlap(queries, held)):
        assert pairs.count() == 700 * 3_000 == pairs.select("q", "id").distinct().count()
        above = pairs._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)[0]
        assert above.count("Generate explode") == 2 and "Join" not in above
    packs = match._packs(queries.withColumn("q_set", F.lit("s")), "q_set", "qs", F.col("q"), "q").select(F.size("qs").alias("n")).collect()
    assert sum(r.n for r in packs) == 3_000 and max(r.n for r in packs) <= match.PACK


def test_uses_are_joined_to_entries_one_by_one(spark, many_of_a_set):
    """A hash join built from the entries would hold all rows of a set, each with its uses, at once."""
    from taleweave.operators import match

    uses = match.reachable(*many_of_a_set)
    join = next(line for line in uses._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert "SortMergeJoin" in join
    rows = uses.collect()
    assert sorted(r.id for r in rows) == list(range(700)) and all(r.uses == list(range(3_000)) for r in rows)
