import random

import pytest
from conftest import values
from pyspark.sql import functions as F
from test_posts import posts

from trendgap.config import UNKNOWN_BRAND, BrandConfig, Rules
from trendgap.functions import text
from trendgap.operators import brands
from trendgap.operators.gold import gold
from trendgap.operators.silver import silver
from trendgap.plans.medallion import bronze


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, priority int")


def found(spark, texts, known):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "post int, caption string").repartition(3)
    out = brands.first_brands(df, F.lower("caption"), known)
    assert out.columns == ["post", "caption", "brand"]
    return [r["brand"] for r in sorted(out.collect(), key=lambda r: r["post"])]


def test_first_brands(spark):
    known = table(
        spark, ("Plum", 1), ("Mamaearth", 0), ("x", 5), ("é!", 2), ("😀z", 3), ("", 0), ("Both", 4), ("both ", 4), (None, 0)
    )
    texts = ["so plump", "MAMAEARTH and plum", "x", None, "", "a é! x", "😀Z", "😀", "both of", "ab", "plu m"]
    assert found(spark, texts, known) == [
        "Plum", "Mamaearth", "x", UNKNOWN_BRAND, UNKNOWN_BRAND, "é!", "😀z", UNKNOWN_BRAND, "Both", UNKNOWN_BRAND,
        UNKNOWN_BRAND,
    ]
    assert found(spark, texts[:3], table(spark)) == [UNKNOWN_BRAND] * 3
    assert found(spark, [], known) == []


def test_first_brands_equal_the_chain_of_tests(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB é\n") for _ in range(n))
    names = tuple(dict.fromkeys(word(rng.randint(1, 6)) for _ in range(40)))
    texts = [word(rng.randint(0, 25)) for _ in range(400)]
    brand = BrandConfig(names[-1], competitors=names[:-1])
    first = {}
    for i, n in enumerate(names):  # as in the chain, the last spelling at the first place
        first[n.lower()] = (first.get(n.lower(), (i,))[0], n)
    known = table(spark, *[(n, i) for i, n in first.values()])
    df = spark.createDataFrame([(t,) for t in texts], "caption string")
    want = values(df.select(text.first_brand(brand, F.lower("caption"))))
    assert found(spark, texts, known) == [b for (b,) in want]


def test_a_short_list_is_tested_as_texts_are_read(spark, monkeypatch):
    """The same rows as by the index, without a shuffle."""
    known = table(spark, ("Plum", 1), ("Mamaearth", 0), ("x", 5), ("é!", 2), ("", 0), ("PLUM", 1), (None, 0))
    texts = ["so plump", "MAMAEARTH and plum", "x", None, "", "a é! x", "plu m"]
    df = spark.createDataFrame([(t,) for t in texts], "caption string")
    plan = brands.first_brands(df, F.lower("caption"), known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
    short = found(spark, texts, known)
    monkeypatch.setattr(brands, "SHORT_LIST", 0)
    assert found(spark, texts, known) == short == ["PLUM", "Mamaearth", "x", UNKNOWN_BRAND, UNKNOWN_BRAND, "é!", UNKNOWN_BRAND]


def test_a_gram_of_all_texts_meets_few_names(spark):
    """Names share a gram that every text has; each is posted under a rarer one."""
    known = table(spark, *[(f"the {k:03}", k) for k in range(200)])
    texts = [f"the {k % 150:03} and the rest" for k in range(600)]
    assert found(spark, texts, known) == [f"the {k % 150:03}" for k in range(600)]
    keys = known.select(F.lower("name").alias("key"), "name", "priority")
    counts = [("the", 600), ("he ", 600), ("e 0", 400), (" 00", 40), ("000", 4)]
    seen = spark.createDataFrame(counts, "gram string, texts bigint")
    posted = {r["name"]: r["gram"] for r in brands.posted(keys, seen).collect()}
    assert posted == {"the 000": "000"}  # any other name has a gram that no text has


@pytest.mark.parametrize("only_own", [False, True])
def test_views_of_brands_equal_gold_of_each(spark, only_own):
    owners = ["A", "B", "C", UNKNOWN_BRAND, None]
    rows = [
        dict(post_id=f"{i:03}", brand=owners[i * 7 % 5], hashtags=[f"#{i % 6}", f"#{i % 4 + 10}"], likes=20 + i * 37 % 900,
             caption=f"natural caption {i}")
        for i in range(80)
    ]
    given = posts(spark, *rows)
    config = {"A": ["#1", "#10"], "B": None, "D": ["#2"], UNKNOWN_BRAND: []}
    known = spark.createDataFrame(list(config.items()), "name string, hashtags array<string>")
    got = brands.gold_for_brands(silver(bronze(given)), known, Rules(), only_own)
    want = []
    for name, targets in config.items():
        own = F.when(F.col("brand").isNotNull(), ~F.col("brand").isin(name, UNKNOWN_BRAND))
        one = silver(bronze(given.withColumn("is_competitor", own)))
        view = gold(one, BrandConfig(name, hashtags=tuple(targets or ())))
        touched = {r["hashtag"] for r in one.filter(F.col("brand") == name).collect()} | set(targets or ())
        want += [(name, *r) for r in values(view) if not only_own or r[0] in touched]
    assert got.columns == ["brand", *view.columns]
    assert sorted(values(got)) == sorted(want)


def test_posts_are_read_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "silver")
    rows = [dict(post_id=str(i), brand="AB"[i % 2], hashtags=[f"#{i % 3}"], likes=50) for i in range(9)]
    silver(bronze(posts(spark, *rows))).write.parquet(path)
    known = spark.createDataFrame([("A", ["#1"]), ("B", [])], "name string, hashtags array<string>")
    frame = brands.gold_for_brands(spark.read.parquet(path), known)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert frame.count() == 6
