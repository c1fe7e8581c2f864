"""Sample files in blocks against the same files read whole."""

import struct

import numpy as np

from taleweave.scratch import fresh_path
from taleweave.sources import samples as sm


def load(spark, folder, **options):
    spark.dataSource.register(sm.Samples)
    reader = spark.read.format("samples").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_blocks_give_the_whole_file(spark):
    rng, folder = np.random.default_rng(1), fresh_path(spark, "clips")
    files = {"a.wav": rng.uniform(-1, 1, 2_500), "b.wav": np.zeros(0), "c.f32": rng.uniform(-2, 2, 1_001), "d.wav": rng.uniform(-1, 1, 100)}
    rows = spark.createDataFrame([(n, 8_000, x.tolist()) for n, x in files.items()], "name string, rate int, samples array<double>")
    written = {r.name: r.bytes for r in sm.write(rows, folder).collect()}
    assert written == {"a.wav": 44 + 5_000, "b.wav": 44, "c.f32": 4_004, "d.wav": 244}
    got = {}
    for r in load(spark, folder, block=100, rate=16_000).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.first] = (r.samples, r.rate, r.n)
    for name, x in files.items():
        parts = [got[name][k] for k in sorted(got[name])]
        whole = [v for p in parts for v in p[0]]
        want = x.astype(np.float32) if name.endswith("f32") else np.clip(np.floor(x * 32768 + 0.5), -32768, 32767) / 32768
        assert np.array_equal(np.array(whole, np.float32), want.astype(np.float32)) and {p[1] for p in parts} == {16_000 if name.endswith("f32") else 8_000}
    heads = {r.path.rsplit("/", 1)[-1]: r.n for r in load(spark, folder, samples="false").collect()}
    assert heads == {n: len(x) for n, x in files.items()} and "samples" not in load(spark, folder, samples="false").columns


def test_chunk_headers():
    plain = sm.wav(np.arange(10), 8_000)
    assert sm.wav_format(plain, len(plain)) == sm.Format(8_000, 1, 44, 20)
    extra = plain[:36] + struct.pack("<4sI", b"LIST", 5) + b"abcde\0" + plain[36:]
    assert sm.wav_format(extra, len(extra)) == sm.Format(8_000, 1, 58, 20)
    assert sm.wav_format(plain[:-4], len(plain) - 4).size == 16
    for broken in (b"", b"RIFF", b"RIFX" + plain[4:], plain[:20] + struct.pack("<H", 3) + plain[22:], plain[:34] + struct.pack("<H", 8) + plain[36:], plain[:36]):
        assert sm.wav_format(broken, len(broken)) is None


def test_broken_files_give_no_rows(spark):
    import pyarrow.fs as pafs

    folder = fresh_path(spark, "clips")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    for name, body in (("x.wav", b"not a wav"), ("y.txt", b"RIFF"), ("z.wav", b"")):
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(body)
    assert load(spark, folder).count() == 0
