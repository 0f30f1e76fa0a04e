"""Sharding along the Hilbert curve against plain sorts."""

import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from booktext_spark.llm import queries, shards

ROWS = "doc_id bigint, text string, lang string, source string, shard string"


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_and_steps_to_a_neighbour(spark, dims, bits):
    cells = list(product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
    place = {r.h: tuple(r)[:dims] for r in df.withColumn("h", shards.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).collect()}
    assert sorted(place) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def plain(rows, number, bits):
    """(doc_id, size, crc, curve) in the order of the shards."""
    sized = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), la, so) for d, t, la, so, _ in rows]
    low = lambda v: (v is not None, v)

    def codes(values):
        return [sum(low(w) < low(v) for w in values) * (1 << bits) // len(values) for v in values]

    columns = [codes([r[i] for r in sized]) for i in (3, 4, 1)]
    table, out = shards.hilbert_table(3), []
    for (d, n, crc, _, _), cell in zip(sized, zip(*columns, strict=True), strict=True):
        s = h = 0
        for level in range(bits - 1, -1, -1):
            f = table[s * 8 + sum((c >> level & 1) << j for j, c in enumerate(cell))]
            s, h = f >> 3, h * 8 + (f & 7)
        out.append((h, low(d), n, crc))
    return [(d[1], n, crc, h) for h, d, n, crc in sorted(out)]


ODD = [(i, "x" * (i * 7 % 50), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 5}", "clash") for i in range(90)]
ODD += [(None, None, None, None, None), (None, None, None, None, None), (5, "", "de", "", ""), (5, "", "de", "", ""), (200, "é" * 4000, "fr", "hot", "")] + [(300, "same", "en", "hot", "")] * 60


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws_on_odd_rows(spark, law):
    made = shards.shard_documents(spark.createDataFrame(ODD, ROWS), 16, bits=3, law=law).collect()
    assert {(r.law, r.grown_shard) for r in made} == {(law, None)}
    order = sorted(made, key=lambda r: (r.shard, r.slot))
    want = plain(ODD, 16, 3)
    assert [(r.doc_id, r.size, r.text_crc32, r.curve) for r in order] == want
    by = {}
    for r in order:
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert [r.slot for r in rows] == list(range(len(rows)))
    if law == "rows":
        assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        at, total = 0, sum(w[1] for w in want)
        for r, w in zip(order, want, strict=True):
            assert r.shard == (2 * at + w[1]) * 16 // (2 * total)
            at += w[1]


def test_fewer_rows_than_shards_and_none(spark):
    few = spark.createDataFrame(ODD[:3], ROWS)
    for law in ("rows", "bytes"):
        got = shards.shard_documents(few, 16, law=law).collect()
        assert len(got) == 3 and all(0 <= r.shard < 16 for r in got) and len({(r.shard, r.slot) for r in got}) == 3
        assert shards.shard_documents(few.limit(0), 16, law=law).collect() == []
    with pytest.raises(ValueError):
        shards.shard_documents(few, 16, law="key")


def test_written_shards_let_readers_skip_files(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 1000), f"l{i % 4}", f"s{i * 7 % 8}", "") for i in range(4000)]
    df = spark.createDataFrame(rows, ROWS).drop("shard")
    found = shards.write_shards(df, f"{tmp_path}/sharded", 16).collect()
    back = spark.read.parquet(f"{tmp_path}/sharded")
    assert sorted(tuple(r)[:4] for r in back.collect()) == sorted(r[:4] for r in rows)
    assert sum(r.n for r in found) == 4000 and len(found) > 12
    # each of the three dimensions alone prunes
    for i, (low, high) in enumerate([("l1", "l1"), ("s2", "s2"), (100, 150)]):
        read = sum(r[f"least_{i}"] <= high and r[f"most_{i}"] >= low for r in found)
        assert read <= 11, (i, read)


def test_main_path_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op13_sharding"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
