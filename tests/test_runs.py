import pytest
from conftest import values
from test_posts import BRAND
from test_streaming import batch, paths  # noqa: F401 - a fixture

from trendgap.operators.gold import gold
from trendgap.plans.medallion import silver_from
from trendgap.sources import posts as files, storage
from trendgap.streaming import medallion as stream, runs


@pytest.mark.parametrize("fan_out", [2, 3, 8])
def test_few_runs_are_left(fan_out):
    found, most = [], 0
    for number in range(600):
        found.append((number, number))
        for whole, members in runs.merges(found, number, fan_out):
            found = [r for r in found if r not in members] + [whole]
        assert [b for r in sorted(found) for b in range(r[0], r[1] + 1)] == list(range(number + 1))
        assert (number, number) in found  # it may be replayed
        most = max(most, len(found))
    levels = next(k for k in range(20) if fan_out**k > 600)
    assert most <= levels * fan_out


def test_what_is_covered_does_not_count_twice():
    assert runs.widest([(0, 0), (1, 1), (0, 1), (2, 2), (0, 3), (4, 4)]) == [(0, 3), (4, 4)]
    assert runs.merges([(0, 0), (1, 1), (2, 2)], 2, 2) == [((0, 1), [(0, 0), (1, 1)])]
    assert runs.merges([(0, 0), (1, 1), (2, 2)], 1, 2) == [] == runs.merges([], 5, 2)


def test_replays_across_merges(spark, paths):  # noqa: F811
    parts = [silver_from(batch(spark, 20 * n, 20)) for n in range(7)]
    want = parts[0]
    for number, part in enumerate(parts):
        want = want.union(part) if number else part
        for _ in range(2 if number in (2, 4, 5) else 1):  # the batch after a merge, once more
            stream.write_partials(part, paths, number)
            stream.compact_partials(spark, paths, number, fan_out=2)
    assert runs.standing(spark, paths.table("partials")) == [(0, 3), (4, 5), (6, 6)]
    assert len(storage.finished_folders(spark, paths.table("partials"))) == 3
    assert sorted(values(stream.refresh_gold(spark, paths, BRAND))) == sorted(values(gold(want, BRAND)))


def test_a_merge_that_broke_off(spark, paths):  # noqa: F811
    """Merged, but what it was merged from is still there; then a draft without an end."""
    parts = [silver_from(batch(spark, 20 * n, 20)) for n in range(3)]
    for number, part in enumerate(parts):
        stream.write_partials(part, paths, number)
    folder = paths.table("partials")
    kept = runs.read(spark, folder, [(0, 0), (1, 1)], stream.PARTIAL)
    stream.fold_partials(kept).write.parquet(f"{folder}/{runs.name(0, 1)}")
    kept.write.parquet(f"{folder}/_draft-{runs.name(0, 7)}")
    want = sorted(values(gold(parts[0].union(parts[1]).union(parts[2]), BRAND)))
    assert sorted(values(stream.refresh_gold(spark, paths, BRAND))) == want
    stream.compact_partials(spark, paths, 2, fan_out=2)
    assert storage.finished_folders(spark, folder) == [runs.name(0, 1), runs.name(2, 2)]
    assert sorted(values(stream.refresh_gold(spark, paths, BRAND))) == want


def test_gold_is_read_while_it_is_refreshed(spark, paths):  # noqa: F811
    assert stream.read_gold(spark, paths).isEmpty()
    first, second = batch(spark, 0, 40), batch(spark, 40, 30)
    files.write_posts(first, paths.landing)
    stream.update(spark, paths, max_files=1, brand=BRAND)
    reader = stream.read_gold(spark, paths)
    files.write_posts(second, paths.landing)
    stream.update(spark, paths, max_files=100, brand=BRAND)
    assert sorted(values(reader)) == sorted(values(gold(silver_from(first), BRAND)))
    both = silver_from(first.union(second))
    assert sorted(values(stream.read_gold(spark, paths))) == sorted(values(gold(both, BRAND)))
