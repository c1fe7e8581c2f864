"""Language-model scores of whole documents: counts of all training words and a gated recurrent network.

1. Every task counts the words of its training documents; one aggregation adds the counts up.
2. Words of a count over a threshold form the dictionary. The threshold comes from a histogram of counts, so that there
   are at most DICTIONARY words of at most WORD_BYTES bytes: that bounds what goes to every task. The SYMBOLS most
   frequent ones are symbols of the network; all others share symbol 0.
3. Documents are written as symbols once. Words outside the dictionary are joined with the counts by a shuffle; only words
   over WORD_BYTES can be frequent among them, and those are dealt over SALTS keys.
4. The network learns from all training documents, dealt to ROUNDS rounds. In a round every task goes on from the common
   parameters over its own documents, and the mean of the tasks' parameters, weighed by tokens, starts the next round.
5. A token's probability is the network's P(symbol | text so far); within symbol 0 it is (c + 1) / (n + v + 1) with the
   word's count c, the n tokens and v words that share the symbol, so that the whole is a distribution over all words
   and one unknown word.

A null doc_id counts as empty text; null text has the end token alone; rows are scored one by one. Without training
documents the network is untrained and the base score is 0 per token. Documents that repeat are learned as often.
Very long texts are learnt in segments and scored whole; columns other than doc_id and text are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm.recurrent import Model
from taleweave.scratch import written

END = b""
DICTIONARY, WORD_BYTES, SYMBOLS = 262_144, 64, 1_023
ROUNDS, LEARN_TOKENS, SCORE_TOKENS = 3, 1_000_000, 4_000_000
#: Distinct words that a counting task holds before it hands them on.
HELD = 500_000
SLICES, LOTS, SALTS = 32, 1024, 16


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def hash_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def word_counts(documents: DataFrame) -> DataFrame:
    """word, c over all texts, the end token once per row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter[bytes] = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                held[END] += 1
                if len(held) > HELD:
                    yield pack()
                    held.clear()
        yield pack()

    return documents.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def dictionary(counts: DataFrame, most: int = DICTIONARY) -> tuple[list[bytes], np.ndarray]:
    """Words of at most WORD_BYTES bytes and their counts, most frequent first behind the end token; never over `most`."""
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    level = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)  # at most 1,008 rows
    total, least = 0, None
    for r in histogram:
        total += r["count"]
        if total >= most:
            break
        least = r["level"]
    rows = [] if least is None else short.where((level >= least) & (F.col("word") != END)).collect()
    found = sorted(((-r["c"], bytes(r["word"])) for r in rows))
    end = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    return [END, *(w for _, w in found)], np.array([end, *(-c for c, _ in found)], np.int64)


def encode(documents: DataFrame, terms: list[bytes], counts: np.ndarray, symbols: int) -> DataFrame:
    """row (unique), doc_id, crc, n_tokens, known (tokens of the dictionary), known_log (sum of log10(c + 1) over them),
    shared (tokens of symbol 0), shared_log (the sum over those of them that are in the dictionary), symbols (uint16),
    rare (words outside the dictionary, each with its number)."""
    shared = documents.sparkSession.sparkContext.broadcast((terms, counts))
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("known_log", pa.float64()),
         ("shared", pa.int64()), ("shared_log", pa.float64()), ("symbols", pa.binary()), ("rare", pa.map_(pa.binary(), pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        own, sizes = shared.value
        at = {w: k for k, w in enumerate(own)}
        look, logs, met = at.get, np.append(np.log10(sizes + 1.0), 0.0), np.append(sizes > 0, False)
        symbol = np.append(np.where(np.arange(len(own)) < symbols, np.arange(len(own)) + 1, 0), 0).astype("<u2")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, crc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = words(text)
                ids = np.fromiter([look(w, -1) for w in ws], np.int64, len(ws))
                ids = np.append(ids, 0)
                sym, log = symbol[ids], logs[ids]
                missing = np.flatnonzero(ids < 0)
                rare = Counter([ws[k] for k in missing.tolist()])
                for column, x in zip(out, (row, doc_id, crc, len(ids), int(met[ids].sum()), float(log.sum()), int((sym == 0).sum()), float(log[sym == 0].sum()), sym.tobytes(), list(rare.items())), strict=True):
                    column.append(x)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    kind = "row long, doc_id long, crc long, n_tokens long, known long, known_log double, shared long, shared_log double, symbols binary, rare map<binary,long>"
    return documents.select("doc_id", hash_of(F.col("doc_id")).alias("crc"), "text").mapInArrow(run, kind)


def _chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents of whole batches, cut at most tokens; a batch comes with the chunk that holds its last document."""
    held: list[np.ndarray] = []
    size, over = 0, []
    for batch in batches:
        for x in batch.column(column).to_pylist():
            held.append(np.frombuffer(x, "<u2"))
            size += len(held[-1])
            if size >= most:
                yield held, over
                held, size, over = [], 0, []
        over.append(batch)
    if held or over:
        yield held, over


def learn(encoded: DataFrame, weights: np.ndarray, start: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters of the network (as packed by Model) after all rounds. encoded: symbols, turn."""
    spark, flat = encoded.sparkSession, Model(weights, start).pack()
    cuts = np.linspace(0, len(flat), SLICES + 1).astype(int).tolist()

    def mean(table: pa.Table) -> pa.Table:
        n = np.array(table.column("tokens").to_pylist(), np.float64)
        x = sum(k * np.frombuffer(b, "<f4").astype(np.float64) for k, b in zip(n, table.column("part").to_pylist(), strict=True)) / n.sum()
        return pa.table({"slice": table.column("slice")[:1], "lot": table.column("lot")[:1], "tokens": [int(n.sum())], "part": [x.astype("<f4").tobytes()]}, schema=schema)

    schema = pa.schema([("slice", pa.int32()), ("lot", pa.int32()), ("tokens", pa.int64()), ("part", pa.binary())])
    kind = "slice int, lot int, tokens long, part binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, seen = Model(weights, start).unpack(sent.value), 0
            for docs, _ in _chunks(batches, "symbols", LEARN_TOKENS):
                if docs:
                    seen += model.train(docs)
            if seen:
                new, lot = model.pack(), TaskContext.get().partitionId() % LOTS
                parts = [new[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"slice": list(range(SLICES)), "lot": [lot] * SLICES, "tokens": [seen] * SLICES, "part": parts}, schema=schema)

        parts = encoded.where(F.col("turn") == turn).select("symbols").mapInArrow(task, kind)
        parts = parts.groupBy("slice", "lot").applyInArrow(mean, kind).groupBy("slice").applyInArrow(mean, kind)
        rows = sorted((r["slice"], bytes(r["part"])) for r in parts.collect())  # one model in all
        if rows:
            flat = np.concatenate([np.frombuffer(b, "<f4") for _, b in rows])
        sent.unpersist()
    return flat


def network_scores(encoded: DataFrame, weights: np.ndarray, start: int, flat: np.ndarray) -> DataFrame:
    """encoded less symbols, with natural_log: the network's log probability of each document's symbols."""
    sent = encoded.sparkSession.sparkContext.broadcast(flat)
    kept = [c for c in encoded.columns if c != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, start).unpack(sent.value)
        waiting: list[np.ndarray] = []
        for docs, over in _chunks(batches, "symbols", SCORE_TOKENS):
            if docs:
                waiting.append(model.score(docs))
            if over:
                scores = np.concatenate(waiting) if waiting else np.zeros(0)
                for batch in over:
                    own, scores = scores[: batch.num_rows], scores[batch.num_rows :]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own)], names=[*kept, "natural_log"])
                waiting = [scores]

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "symbols"]
    return encoded.mapInArrow(run, ", ".join([*fields, "natural_log double"]))


def score(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = documents.sparkSession
    train = documents.where(hash_of(F.col("doc_id")) % folds != held)
    counts = written(word_counts(train), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0]), int(total[1])
    terms, sizes = dictionary(counts)
    symbols = min(SYMBOLS, len(terms))
    encoded = written(encode(documents, terms, sizes, symbols), "lm-symbols")

    alone = tokens - int(sizes[:symbols].sum())
    weights = np.concatenate([[max(alone, 0)], sizes[:symbols]])
    turn = ((F.col("crc") / folds).cast("long") % ROUNDS).cast("int")
    flat = learn(encoded.where(F.col("crc") % folds != held).select("symbols", turn.alias("turn")), weights, 1)
    scored = network_scores(encoded.select("row", "doc_id", "crc", "n_tokens", "known", "known_log", "shared", "shared_log", "symbols"), weights, 1, flat)

    long = F.octet_length("word") > WORD_BYTES
    rare = encoded.select("row", F.explode("rare").alias("word", "tf"))
    rare = rare.withColumn("salt", F.when(long, F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(long, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    rare = rare.join(spread, ["word", "salt"], "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * F.log10(c + F.lit(1.0))).alias("rare_log"))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    rare_log = F.coalesce("rare_log", none)
    base = F.col("known_log") + rare_log - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))
    rest = float(np.log10(max(alone, 0) + max(distinct - symbols, 0) + 1))
    full = F.col("natural_log") / F.lit(float(np.log(10))) + F.col("shared_log") + rare_log - F.col("shared") * F.lit(rest)
    return scored.join(rare, "row", "left").select(
        "doc_id", (F.col("crc") % folds == held).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"),
    )
