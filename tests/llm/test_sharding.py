import hashlib
from collections import Counter

import pytest

from taleweave.llm import sharding
from taleweave.scratch import fresh_path
from tests.llm.helpers import awkward, clashing, empty

NAMES = [f"s{k}" for k in range(7)]


def test_table_is_even_and_steady():
    table = sharding.fill_table(NAMES, 1009)
    share = Counter(table)
    assert len(table) == 1009 and max(share.values()) - min(share.values()) <= 1
    less = sharding.fill_table(NAMES[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 6)
    assert moved < 0.15 * 1009
    assert sharding.fill_table(NAMES, 1009) == table
    for bad in ([], ["a", "a"], [str(k) for k in range(12)]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 11)


@pytest.mark.parametrize("slots", [7, 11, 499])
def test_table_against_lists_of_preferences(slots):
    """The rule written a second time: whole preference lists, and the first entry of each that nobody has."""
    number = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)
    lists = [[(number(f"at:{n}") + k * (1 + number(f"skip:{n}") % (slots - 1))) % slots for k in range(slots)] for n in NAMES]
    assert all(sorted(x) == list(range(slots)) for x in lists)
    owner = {}
    for turn in range(slots):
        shard = turn % len(NAMES)
        owner[next(x for x in lists[shard] if x not in owner)] = shard
    assert sharding.fill_table(NAMES, slots) == [owner[k] for k in range(slots)]


def test_placement(spark):
    table = sharding.fill_table(NAMES)
    for df in (awkward(spark), clashing(awkward(spark))):
        out = sharding.place(df, NAMES)
        assert {"slot", "shard", "shard_name"} <= set(out.columns)
        rows = out.collect()
        assert len(rows) == 9
        for r in rows:
            slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % sharding.SLOTS
            assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], NAMES[table[slot]])
    assert sharding.place(empty(spark), NAMES).count() == 0


def test_written_shards_hold_whole_rows(spark, data):
    docs, path = spark.read.parquet(f"{data}/documents.parquet"), fresh_path(spark, "shards")
    back = sharding.write_shards(docs.repartition(9), path, NAMES, rows_a_file=20)
    want = {r.doc_id: r for r in sharding.place(docs, NAMES).collect()}
    assert {r.doc_id: tuple(r) for r in back.collect()} == {k: tuple(r) for k, r in want.items()}
    for name in {r.shard_name for r in want.values()}:
        folder = f"{path}/shard_name={name}"
        files = spark.read.parquet(folder).select("_metadata.file_path").distinct().count()
        assert 1 <= files <= -(-docs.count() // (20 * len(NAMES)))


def test_written_shards_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        back = sharding.write_shards(df, fresh_path(spark, "shards"), NAMES)
        key = lambda r: (repr(r.doc_id), repr(r.text))
        assert sorted(map(key, back.collect())) == sorted(map(key, df.collect())) and set(df.columns) | {"slot", "shard", "shard_name"} == set(back.columns)
    assert sharding.write_shards(empty(spark), fresh_path(spark, "shards"), NAMES).count() == 0


def test_one_key_on_all_rows_spreads_over_files(spark):
    rows, joined = spark.range(4_000).selectExpr("7L AS doc_id", "id AS n").repartition(4), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")  # small parts would be put together
    try:
        back = sharding.write_shards(rows, fresh_path(spark, "shards"), NAMES, rows_a_file=40)
    finally:
        spark.conf.unset(joined)
    sizes = [r["count"] for r in back.select("_metadata.file_path").groupBy("file_path").count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) > 1 and max(sizes) < 2_600
