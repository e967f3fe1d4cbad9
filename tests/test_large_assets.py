"""Files that are read in pieces have the digests of their bytes, whatever they hold and however they are called."""

import gzip
import hashlib
import random

import pytest

from tallyframe.sources import readers


def written(tmp_path):
    rng = random.Random(5)
    contents = {
        "noise.bin": rng.randbytes(300_000), "ends.bin": rng.randbytes(70_000) + b"\n", "feeds.bin": b"\n" * 70_000, "one line.txt": b"x" * 90_000,
        "returns.txt": b"a\r\nb\r\r\n" * 20_000 + b"\r", "mark.txt": readers.MARK + b"line\n" * 20_000, "mark only.txt": readers.MARK + b"line\n" * 20_000 + readers.MARK,
        "packed.gz": gzip.compress(rng.randbytes(90_000)), "not packed.gz": rng.randbytes(90_000), "no ending": rng.randbytes(90_000), "od[d]*{n,m}?.bin": rng.randbytes(90_000),
        "small.bin": b"small\n", "%41 ü.snappy": rng.randbytes(80_000),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    return {(name, len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items()}


def test_pieces_give_the_digests_of_whole_files(spark, tmp_path):
    want = written(tmp_path)
    # Splits and batches are far smaller than the files.
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = readers.hash_assets(spark, str(tmp_path), str(tmp_path), pieces=50_000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_large_file_is_never_a_row(spark, tmp_path):
    want = written(tmp_path)
    # Spark refuses binary files of more than 2 GB as rows; the bound stands for that here.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60000")
    try:
        got = readers.hash_assets(spark, str(tmp_path), str(tmp_path), pieces=50_000).collect()
        assert {tuple(r) for r in got} == want
        with pytest.raises(Exception, match="(?i)length"):
            readers.hash_assets(spark, str(tmp_path), str(tmp_path), pieces=2**40).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
