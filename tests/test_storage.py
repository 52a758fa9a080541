import pytest
from conftest import values
from pyspark.sql import DataFrameWriter, functions as F
from test_gaps import varied
from test_posts import BRAND, posts

from trendgap.operators.gold import gold
from trendgap.operators.silver import silver
from trendgap.plans import medallion
from trendgap.schemas import GAP_CLUSTER, INSIGHT
from trendgap.sources import storage


def test_overwrite_replaces_rows_and_schema(spark, tables):
    storage.ensure_database(spark, tables)
    storage.ensure_database(spark, tables)
    storage.overwrite_table(spark.createDataFrame([(1,)], "a int"), tables.full("gaps"))
    storage.overwrite_table(spark.createDataFrame([("x", 2.0)], "b string, c double"), tables.full("gaps"))
    assert values(spark.table(tables.full("gaps"))) == [("x", 2.0)]


def test_empty_result_leaves_a_typed_table(spark, tables):
    storage.ensure_database(spark, tables)
    storage.overwrite_table(storage.empty(spark, GAP_CLUSTER), tables.full("gaps"))
    stored = spark.table(tables.full("gaps"))
    assert stored.count() == 0
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in GAP_CLUSTER]


def test_read_or_default(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("gold")
    default = spark.createDataFrame([(7,)], "a int")
    assert values(storage.read_table(spark, name, default)) == [(7,)]
    assert storage.read_table(spark, name, schema=INSIGHT).count() == 0
    with pytest.raises(ValueError):
        storage.read_table(spark, name)
    storage.overwrite_table(default.limit(0), name)
    assert values(storage.read_table(spark, name, default)) == [(7,)]
    assert storage.read_table(spark, name).count() == 0
    storage.append_table(spark.createDataFrame([(8,)], "a int"), name)
    assert values(storage.read_table(spark, name, default)) == [(8,)]


def test_intermediate_data_goes_to_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = storage.shared_path(spark, "x"), storage.shared_path(spark, "x")
    assert first != second and first.startswith(base)
    frame = spark.createDataFrame([(1, ["a"])], "a int, b array<string>")
    kept = storage.materialise(frame, "x")
    assert kept.schema == frame.schema and values(kept) == values(frame)
    assert base in kept.inputFiles()[0]


def test_table_jobs(spark, tables):
    rows = posts(spark, *[dict(post_id=str(i), hashtags=[f"#{i % 5}"], caption=f"caption number {i}") for i in range(40)])
    medallion.refresh_tables(rows, BRAND, tables=tables)
    expected = gold(silver(medallion.bronze(rows)), BRAND)
    assert sorted(values(spark.table(tables.full("gold")))) == sorted(values(expected))
    report = medallion.refresh_gaps(spark, tables=tables)
    assert sorted(values(spark.table(tables.full("gaps")))) == sorted(values(report.gaps))


def test_gap_job_without_gold_writes_an_empty_table(spark, tables):
    medallion.refresh_gaps(spark, tables=tables)
    stored = spark.table(tables.full("gaps"))
    assert stored.count() == 0 and stored.columns == GAP_CLUSTER.names


def test_gap_job_replaces_its_table(spark, tables):
    storage.ensure_database(spark, tables)
    storage.overwrite_table(varied(spark), tables.full("gold"))
    medallion.refresh_gaps(spark, tables=tables)
    first = spark.table(tables.full("gaps")).count()
    medallion.refresh_gaps(spark, tables=tables)
    assert spark.table(tables.full("gaps")).count() == first


def rows(spark, *given):
    return spark.createDataFrame(list(given), "k int, l string, v string")


def test_appends_lose_and_double_nothing(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    batch = [(None, "x", "a"), (None, "x", "b"), (1, "x", "c"), (1, None, "d"), (1, None, "d"), (None, None, None)]
    for given in (batch, batch, batch[1:] + [(2, "x", "e")], list(reversed(batch))):
        storage.append_new(rows(spark, *given), name, "k", "l")
    stored = spark.table(name)
    assert stored.columns == ["k", "l", "v"]
    assert sorted(map(repr, values(stored))) == sorted(map(repr, {*batch, (2, "x", "e")}))
    assert not spark.catalog.tableExists(f"{name}_clashes")


def test_rows_of_one_key_and_another_content_are_kept_apart(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    storage.append_new(rows(spark, (1, "x", "first")), name, "k", "l", volatile=("v",))
    storage.append_new(rows(spark, (1, "x", "later")), name, "k", "l", volatile=("v",))
    assert values(spark.table(name)) == [(1, "x", "first")] and not spark.catalog.tableExists(f"{name}_clashes")
    for _ in range(2):
        storage.append_new(rows(spark, (1, "x", "a"), (2, "x", "b"), (2, "x", "c"), (2, "x", "d")), name, "k", "l")
    kept = sorted(values(spark.table(name)))
    clashes = sorted(values(spark.table(f"{name}_clashes"), "k", "l", "v"))
    assert [k for k, *_ in kept] == [1, 2] and kept[0] == (1, "x", "first")
    assert sorted({*kept, *clashes}) == [(1, "x", "a"), (1, "x", "first"), (2, "x", "b"), (2, "x", "c"), (2, "x", "d")]
    assert len(kept) + len(clashes) == 5


def test_an_append_reads_only_the_folders_of_its_keys(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    storage.append_new(rows(spark, *[(k, "x", "v") for k in range(300)]), name, "k")
    ledger = spark.table(f"{name}_ledger")
    assert ledger.select(storage.BUCKET).distinct().count() == storage.BUCKETS
    met = storage._marked(rows(spark, (7, "x", "v")), ("k",), ()).first()[storage.BUCKET]
    plan = ledger.filter(ledger[storage.BUCKET].isin([met])).select("k")._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({storage.BUCKET}" in plan and "ReadSchema: struct<k:int>" in plan
    read = ledger.filter(ledger[storage.BUCKET].isin([met])).inputFiles()
    before = set(ledger.inputFiles())
    storage.append_new(rows(spark, (7, "x", "v"), (1007, "x", "v")), name, "k")
    added = set(spark.table(f"{name}_ledger").inputFiles()) - before
    assert len(added) == 1 and read and spark.table(name).count() == 301


def test_a_repeated_append_shuffles_keys_and_digests_only(spark, tables, monkeypatch):
    storage.ensure_database(spark, tables)
    name, batch = tables.full("events"), rows(spark, *[(k, "x", "value") for k in range(300)])
    storage.append_new(batch, name, "k")
    before, stored, materialise = set(spark.table(f"{name}_ledger").inputFiles()), [], storage.materialise

    def spy(frame, label):
        out = materialise(frame, label)
        stored.append((frame, out.count()))
        return out

    monkeypatch.setattr(storage, "materialise", spy)
    storage.append_new(batch, name, "k")
    assert set(spark.table(f"{name}_ledger").inputFiles()) == before
    for frame, count in stored:
        if "Exchange" in frame._jdf.queryExecution().executedPlan().toString():
            assert "v:string" not in frame.schema.simpleString() and count == 0


def test_rows_of_a_plain_table_are_taken_in(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    storage.append_table(rows(spark, (1, "x", "a"), (None, "x", "b")), name)
    for _ in range(2):
        storage.append_new(rows(spark, (1, "x", "a"), (None, "x", "b"), (3, "x", "c")), name, "k")
    assert sorted(map(repr, values(spark.table(name)))) == sorted(
        map(repr, [(1, "x", "a"), (None, "x", "b"), (3, "x", "c")])
    )
    with pytest.raises(ValueError, match="append_new"):
        storage.append_table(rows(spark, (4, "x", "d")), name)


def test_readers_see_old_rows_or_new_ones(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("gaps")
    storage.append_table(spark.createDataFrame([(0,)], "a int"), name)  # a plain table gives way
    for n in (1, 2, 3):
        storage.overwrite_table(spark.createDataFrame([(n,)], "a int"), name)
        reader = spark.table(name)
        storage.overwrite_table(reader.selectExpr("a * 10 AS a"), name)  # from the table itself
        assert values(reader) == [(n,)] and values(spark.table(name)) == [(10 * n,)]
    folder = storage._versions(spark, name)
    assert len(storage.finished_folders(spark, folder)) == storage.KEPT_VERSIONS


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "v")
    assert storage.newest_version(spark, path) is None
    first = storage.write_version(spark.createDataFrame([(1,)], "a int"), path)
    (tmp_path / "v" / "version-000000000001").mkdir()
    (tmp_path / "v" / "_draft-x").mkdir()
    assert storage.newest_version(spark, path) == first
    second = storage.write_version(spark.createDataFrame([(2,)], "a int"), path)
    assert storage.newest_version(spark, path) == second and values(spark.read.parquet(second)) == [(2,)]


def watched(monkeypatch):
    """What is stored for later passes and what is appended to a table, each with its plan."""
    stored, appended, materialise, save = [], [], storage.materialise, DataFrameWriter.saveAsTable

    def spy(frame, label):
        stored.append(frame)
        return materialise(frame, label)

    def saved(writer, name, *args, **more):
        files = int(writer._spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        appended.append((writer._df._jdf.queryExecution().executedPlan().toString(), files))
        return save(writer, name, *args, **more)

    monkeypatch.setattr(storage, "materialise", spy)
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", saved)
    return stored, appended


def test_an_append_shuffles_numbers_only_and_sorts_no_rows(spark, tables, monkeypatch):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    stored, appended = watched(monkeypatch)
    limit = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for first in (0, 1000):  # all new, then half of them
        storage.append_new(rows(spark, *[(k, "x", f"value {k}") for k in range(first, first + 2000)]), name, "k")
    assert sorted(values(spark.table(name))) == [(k, "x", f"value {k}") for k in range(3000)]
    assert len(appended) == 2
    for plan, files in appended:
        assert "hashpartitioning" not in plan.split("BroadcastExchange")[0] and "REBALANCE" not in plan
        assert files > storage.BUCKETS
    shuffled = [f for f in stored if "Exchange" in f._jdf.queryExecution().executedPlan().toString()]
    assert shuffled and all({kind for _, kind in f.dtypes} == {"bigint"} for f in shuffled)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == limit


@pytest.mark.parametrize("one_hash", [False, True])
def test_appends_of_repeats_nulls_and_clashes_of_one_hash(spark, tables, monkeypatch, one_hash):
    if one_hash:  # keys that share a hash are told apart by what they are
        monkeypatch.setattr(storage, "_hashed", lambda keys, other: F.lit(7).cast("bigint"))
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    first = [(k, "x", "a") for k in range(1500)] + [(None, "x", "a"), (None, "x", "b")]
    again = [(k, "x", "a") for k in range(1000, 1600)] * 2 + [(None, "x", "b"), (None, "x", "c")]
    other = [(3, "x", "z"), (1600, "x", "p"), (1600, "x", "q"), (1600, "x", "q")]
    storage.append_new(rows(spark, *first), name, "k")
    for _ in range(2):
        storage.append_new(rows(spark, *again, *other), name, "k")
    kept = [r for r in values(spark.table(name)) if r[0] != 1600]
    assert sorted(kept, key=repr) == sorted({*first, *again}, key=repr)
    (stands,) = [r for r in values(spark.table(name)) if r[0] == 1600]
    clashes = sorted(values(spark.table(f"{name}_clashes"), "k", "l", "v"))
    assert clashes == sorted([(3, "x", "z"), *({(1600, "x", "p"), (1600, "x", "q")} - {stands})])


def test_numbered_rows_are_those_of_the_numbers(spark):
    part = 1 << 33  # row numbers of the second task begin here
    every = [*range(1200), *range(part, part + 700)]
    wanted = sorted({n for n in every if n % 7 == 0} | {0, 63, 64, 511, 512, 1023, part, part + 575})
    frame = spark.createDataFrame([(n, str(n)) for n in every], "_row bigint, v string")
    numbers = spark.createDataFrame([(n,) for n in wanted], "_row bigint")
    assert sorted(values(storage._numbered(frame, numbers), "_row", "v")) == [(n, str(n)) for n in wanted]


def test_small_appends_leave_few_files(spark, tables):
    storage.ensure_database(spark, tables)
    name = tables.full("events")
    storage.append_new(rows(spark, *[(k, "x", "v") for k in range(3000)]).repartition(8), name, "k")
    assert len(spark.table(f"{name}_ledger").inputFiles()) == storage.BUCKETS
