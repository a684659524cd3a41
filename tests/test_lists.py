"""Next-fit over tables against the planner's own pass over one list."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import lists, plan


def packed(spark, wanted, budget, units):
    rows = [(key, i, line) for key, own in wanted.items() for i, line in enumerate(own)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, i int, line string").repartition(5)
    got = lists.next_fit(df, ["key"], ["i"], F.col("line"), budget, units=units)
    assert got.columns == ["key", "i", "line", "bucket"]
    out = {key: [] for key in wanted}
    for r in got.orderBy("key", "i").collect():
        out[r.key].append(r.bucket)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_blocks_number_as_one_pass_does(spark, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice("xé😀") * (rng.choice([0, 1, 3, 7, 12]) if rng.random() < 0.97 else rng.choice([41, 200, 1000]))
    wanted = {key: [line() for _ in range(n)] for key, n in {"long": 3000, "some": 150, "one": 1, None: 60}.items()}
    wanted["wide"] = ["y" * 500] * 4
    wanted["exact"] = ["z" * 9, "z" * 10] * 40  # 9 + 1 + 10 units cost exactly 5 tokens
    got = packed(spark, wanted, 5, 64)
    assert got == {key: plan.bucket_numbers(own, 5) for key, own in wanted.items()}


def test_one_block_and_many_agree(spark):
    rng = random.Random(9)
    wanted = {"a": ["w" * rng.randint(5, 60) for _ in range(2000)], "b": ["", "", ""]}
    assert packed(spark, wanted, 50, 500) == packed(spark, wanted, 50, 1 << 17) == {k: plan.bucket_numbers(v, 50) for k, v in wanted.items()}


def test_a_third_in_one_list_spreads_over_tasks(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), "id", F.lit("- [a line](of-a-table.md)").alias("line"))
    got = lists.next_fit(rows, ["key"], ["id"], F.col("line"), 50, units=4096).filter("key = 'hot'")
    each = len(plan.bucket_numbers(["- [a line](of-a-table.md)"] * 20000, 50))
    assert each > 1 and got.agg(F.count(F.lit(1)), F.max("bucket"), F.countDistinct("bucket")).first() == (20000, max(plan.bucket_numbers(["- [a line](of-a-table.md)"] * 20000, 50)), max(plan.bucket_numbers(["- [a line](of-a-table.md)"] * 20000, 50)))


def test_empty_null_and_extra_columns(spark):
    schema = "key string, i int, at int, block int, list_id string, line string"
    empty = spark.createDataFrame([], schema)
    assert lists.next_fit(empty, ["key"], ["i"], F.col("line"), 5).collect() == []
    rows = spark.createDataFrame([(None, 1, 7, 8, "x", None), (None, 2, 7, 8, "x", None), ("k", 1, 7, 8, "x", "l" * 30)], schema)
    got = lists.next_fit(rows, ["key"], ["i"], F.col("line"), 5)
    assert got.columns == [*rows.columns, "bucket"] and sorted((r.key or "", r.i, r.bucket, r.at) for r in got.collect()) == [("", 1, 1, 7), ("", 2, 1, 7), ("k", 1, 1, 7)]
    with pytest.raises(ValueError, match="too small"):
        lists.next_fit(rows, ["key"], ["i"], F.col("line"), 5, units=40)


def test_groups_of_groups_as_the_planner_makes_them(spark):
    rng = random.Random(4)
    rows = [(key, i, rng.choice(["Alpha", "Beta", "Gamma", "Delta wing"]), f"s{i}") for key, n in {"big": 400, "mid": 30, "tiny": 1}.items() for i in range(n)]
    rows += [("wide", i, "n" * 150, "s") for i in range(3)]  # no two lines fit together: packing gains nothing
    got = lists.grouped_lists(spark.createDataFrame(rows, "key string, i int, name string, slug string"), ["key"], "i", 20)
    found = {}
    for r in got.orderBy("key", "place").collect():
        found.setdefault(r.key, []).append((r.name, r.slug, r.links))
    for key in ("big", "mid", "tiny", "wide"):
        flat = [plan.Entry(name, slug, False) for k, _, name, slug in rows if k == key]
        assert found.get(key, []) == [(e.name, e.slug, [m.link for m in e.members]) for e in plan.grouped(flat, 20) if e.members]
    assert max(link for links in (g[2] for g in found["big"]) for link in links).startswith("group-")


def test_first_groups_of_a_list_whose_groups_need_groups(spark):
    rows = [("big", i, f"n{i}", f"s{i}") for i in range(400)] + [("tiny", 0, "n", "s")]
    got = lists.first_groups(spark.createDataFrame(rows, "key string, i int, name string, slug string"), ["key"], "i", 20).orderBy("place").collect()
    flat = [plan.Entry(name, slug, False) for key, _, name, slug in rows if key == "big"]
    numbers = plan.bucket_numbers([e.line for e in flat], 20)
    assert plan.cost([f"- [{r.name}]({r.slug}/index.md)" for r in got]) > 20  # grouped_lists goes on from here
    assert [(r.key, r.place, r.slug) for r in got] == [("big", n, f"group-{n}") for n in range(1, numbers[-1] + 1)]
    assert [link for r in got for link in r.links] == [e.link for e in flat] and [len(r.links) for r in got] == [numbers.count(r.place) for r in got]
