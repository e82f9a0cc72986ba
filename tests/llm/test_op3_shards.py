import os
import zlib
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import shards
from ridgeline.llm.common import new_folder
from ridgeline.llm.tokens import default_files, encoder


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = shards.feistel(np.arange(n), n, "k")
    assert sorted(got.tolist()) == list(range(n))


def test_feistel_depends_on_the_key_and_mixes():
    a, b = (shards.feistel(np.arange(5000), 5000, k) for k in ("k", "l"))
    assert (a != b).mean() > 0.9
    assert abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def expected(texts, seq_len):
    encode = encoder(*default_files())
    out = Counter()
    for doc_id, text in texts:
        ids = np.array([*encode(text or ""), 2], "<u4")
        for k, s in enumerate(range(0, len(ids), seq_len)):
            part = ids[s : s + seq_len]
            out[(doc_id, k, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def test_shards_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.materialise(spark, docs, "k", seq_len=256, per_shard=100).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.piece, r.n_tokens, r.ids_crc32) for r in rows) == expected(texts, 256)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert len(by_shard) > 20 and max(map(len, by_shard.values())) < 200
    assert all(sorted(s) == list(range(min(s), min(s) + len(s))) for s in by_shard.values())
    # the order is that of the permuted grid
    grid, _ = shards.grid_of(docs.select("doc_id", "text"), 256)
    place = {r.slot: int(shards.feistel(np.array([(r.doc_id - grid.low) * grid.pieces + r.piece]), grid.size, "k")[0]) for r in rows}
    assert [place[s] for s in sorted(place)] == sorted(place.values())
    # and it does not depend on how the rows are dealt out
    again = shards.materialise(spark, docs.repartition(7), "k", seq_len=256, per_shard=100).collect()
    assert {r.slot: r for r in again} == {r.slot: r for r in rows}


def test_files_have_a_fixed_stride_and_resume(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = new_folder(spark, "shards-test")
    files = shards.write_shards(docs, folder, "k", seq_len=128, per_shard=50)
    stride = shards.HEADER_BYTES + 256
    assert all(os.path.getsize(r.path.removeprefix("file://")) == stride * r.records for r in files.collect())
    assert not [f for f in os.listdir(folder.removeprefix("file://")) if f.startswith(".part")]
    whole = {r.slot: r for r in shards.read_shards(spark, files, 128).collect()}
    assert sorted(whole) == list(range(len(whole)))
    rest = shards.read_shards(spark, files, 128, first_slot=77).collect()
    assert {r.slot: r for r in rest} == {s: r for s, r in whole.items() if s >= 77}


def test_ids_far_apart(spark):
    data = [(-(2**63), "a b c"), (2**63 - 1, "d e"), (0, "x " * 5000)]
    rows = shards.materialise(spark, spark.createDataFrame(data, "doc_id long, text string"), "k").collect()
    assert Counter((r.doc_id, r.piece, r.n_tokens, r.ids_crc32) for r in rows) == expected(data, shards.SEQ_LEN)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_edges(spark):
    long = "word " * 30000
    data = [(1, None), (2, ""), (None, "x y"), (3, long), (3, long)]
    docs = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, slot int, shard int").coalesce(2)
    rows = shards.materialise(spark, docs, "k").collect()
    assert Counter((r.doc_id, r.piece, r.n_tokens, r.ids_crc32) for r in rows) == expected(data, shards.SEQ_LEN)
    assert shards.materialise(spark, docs.limit(0), "k").collect() == []
