import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vellumetry.llm.token_store import LEAST, MOST, Encoder, MerkleStream, crc_shift, cuts, merkle, read_ids, read_sums, write_store

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(FILE)


def expected(lib, rows):
    start, out = 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_parts_encode_as_in_the_text(lib):
    texts = ["It's Ünïcode, İΣ! \n\r\n tab\there", "<|endoftext|> x<|ENDOFTEXT|>", "Ẃ W̊ é É", " 12 ab3c!?,. don't WE'LL", "", "a b c"]
    got = Encoder(FILE).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_cover_and_follow_content():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 40_000, 20_000).astype("<u2")
    ends = cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= MOST and sizes[:-1].min() >= LEAST
    moved = cuts(np.concatenate([ids[:10], ids]))
    assert len({e + 10 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert cuts(np.zeros(1, "<u2")) == [1] and cuts(np.zeros(9000, "<u2"))[-1] == 9000


def test_crc_of_joined_parts():
    a, b = b"first part", b"and the second"
    raw = lambda x: zlib.crc32(x, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert crc_shift(np.array([raw(a)]), np.array([len(b)]))[0] ^ raw(b) == raw(a + b)


def test_merkle_tells_order_and_length():
    x = [bytes([i]) for i in range(7)]
    assert len({merkle(x), merkle(x[::-1]), merkle(x[:-1]), merkle([])}) == 4
    stream = MerkleStream()
    for leaf in x[:4]:
        stream.add(leaf)
    assert stream.root() == merkle(x[:4])


def test_round_trip(spark, odd, odd_rows, lib, tmp_path):
    path = write_store(odd, FILE, 2, f"file://{tmp_path}/store")
    by_id = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_sums(spark, path).collect()), key=lambda r: r[1])
    want = expected(lib, sorted(((r[0], r[1]) for r in odd_rows), key=by_id))
    assert [(r[0], r[2], r[3]) for r in got if r[0] is not None] == [(r[0], r[2], r[3]) for r in want if r[0] is not None]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)]).tolist()[:-1]
    for r in read_ids(spark, path, spark.createDataFrame([(3,), (8,)], "doc_id long")).collect():
        text = next(t for i, t, *_ in odd_rows if i == r.doc_id)
        assert list(r.ids) == [*lib.encode(text, add_special_tokens=False).ids, 2]
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    assert sum(m.docs for m in manifest) == len(odd_rows) and sum(m.tokens for m in manifest) == sum(r[2] for r in want)
    assert spark.read.parquet(f"{path}/chunks").groupBy("digest").count().filter("count > 1").count() == 0


def test_files_ascend(spark, tmp_path):
    """Over the files in order of name, also where many records share an id."""
    rows = [(i, f"text {i} {k}") for i in (None, *range(60), 7, 7, 7) for k in range(9)]
    random.Random(3).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small partitions apart
    try:
        write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), FILE, 2, f"file://{tmp_path}/store")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    ids, starts = [], []
    files = sorted((tmp_path / "store/recipes").glob("part-*.parquet"))
    for f in files:
        table = pq.read_table(f, columns=["doc_id", "start"]).to_pydict()
        ids += [-1 if i is None else i for i in table["doc_id"]]
        starts += table["start"]
    assert len(files) > 1 and len(ids) == len(rows) and ids == sorted(ids) and starts == sorted(starts)


def test_lost_rows_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for table, rule in (("chunks", "digest <> (select min(digest) from t)"), ("recipes", "doc_id <> 4"), ("manifest", "part <> 0")):
        path = write_store(docs, FILE, 2, f"file://{tmp_path}/{table}")
        spark.read.parquet(f"{path}/{table}").createOrReplaceTempView("t")
        left = spark.sql(f"select * from t where {rule}").collect()
        schema = spark.table("t").schema
        spark.createDataFrame(left, schema).write.mode("overwrite").parquet(f"{path}/{table}")
        with pytest.raises(Exception, match="damaged"):
            read_sums(spark, path).collect()


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, " ".join(random.Random(1).choices("abcdef", k=500)))], "doc_id long, text string")
    path = write_store(docs, FILE, 2, f"file://{tmp_path}/store")
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    bad = [(bytes(c.digest), c.n, bytes(c.ids)[:-1] + b"\x09") for c in chunks]
    spark.createDataFrame(bad, "digest binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        read_sums(spark, path).collect()


def test_empty_table(spark, none, tmp_path):
    assert read_sums(spark, write_store(none, FILE, 2, f"file://{tmp_path}/store")).count() == 0
