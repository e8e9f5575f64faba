"""Feature matrix: the hand-worked case and a brute-force reference."""

import random
from collections import Counter

from affinity import schemas
from affinity.operators import features as FT

DAY = FT.DAY_MS


def _ratings(spark, rows):
    return spark.createDataFrame(rows, schemas.ENGAGEMENT_RATING)


def _expand(ff):
    """Matrix rows with each user's rated set inlined (test-side only)."""
    entries = [tuple(r) for r in ff.matrix().collect()]
    sets = {}
    for r in ff.rated_block().collect():
        sets.setdefault(r.user_row, []).append((r.col, r.cat, r.value))
    out = list(entries)
    for row, col, cat, value in entries:
        if cat == "user":
            out += [(row, c, k, v) for c, k, v in sets[col]]
    return Counter(out)


def _brute(rows):
    """The matrix as specified, all blocks inline, from plain Python."""
    users = {k: i for i, k in enumerate(sorted({(r[0], r[1]) for r in rows}))}
    items = {k: i for i, k in enumerate(sorted({r[2] for r in rows}))}
    U, I = len(users), len(items)
    b, c, d, e = U, U + I, U + 2 * I, U + 3 * I
    begin = min(r[4] for r in rows)
    order = sorted(rows, key=lambda r: (users[(r[0], r[1])], r[4], items[r[2]], r[5], r[3]))
    out = Counter()
    for i, r in enumerate(order):
        u = users[(r[0], r[1])]
        mine = [x for x in order if users[(x[0], x[1])] == u]
        out[(i, u, "user", 1.0)] += 1
        out[(i, b + items[r[2]], "item", 1.0)] += 1
        for x in mine:
            out[(i, c + items[x[2]], "context_categorical_set", 1.0 / len(mine))] += 1
        earlier = [x for x in mine if (x[4], items[x[2]]) < (r[4], items[r[2]])]
        if earlier:
            last = max(earlier, key=lambda x: (x[4], items[x[2]]))
            out[(i, d + items[last[2]], "context_categorical", 1.0)] += 1
        out[(i, e, "context_numerical", float((r[4] - begin) // DAY))] += 1
        out[(i, e + 1, "context_numerical", float(r[5]))] += 1
        out[(i, e + 2, "label", float(r[3]))] += 1
    return out


def test_hand_worked(spark):
    rows = [("s", "u1", "x", 5.0, 0, 7), ("s", "u1", "y", 60.0, 2 * DAY, 3), ("s", "u2", "x", 100.0, DAY, 1)]
    ff = FT.prepare(_ratings(spark, rows))
    layout = ff.layout().first()
    assert (layout.users, layout.items, layout.rated_offset, layout.previous_offset, layout.time_col,
            layout.event_col, layout.label_col) == (2, 2, 4, 6, 8, 9, 10)
    got = _expand(ff)
    row1 = sorted((col, cat, v) for (row, col, cat, v) in got.elements() if row == 1)
    assert row1 == [(0, "user", 1.0), (3, "item", 1.0), (4, "context_categorical_set", 0.5),
                    (5, "context_categorical_set", 0.5), (6, "context_categorical", 1.0),
                    (8, "context_numerical", 2.0), (9, "context_numerical", 3.0), (10, "label", 60.0)]
    # rows 0 and 2 have no previous item
    assert not [k for k in got if k[0] in (0, 2) and k[2] == "context_categorical"]
    assert got == _brute(rows)


def test_brute_force_with_duplicates_and_equal_times(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(120):
        u = rnd.choice(["a", "b", "c", "hot", "hot", "hot"])
        rows.append(("s", u, f"i{rnd.randrange(5)}", float(rnd.randrange(1, 4)), rnd.randrange(4) * DAY // 2,
                     rnd.choice([1, 3, 7])))
    rows += [rows[0]] * 5  # explicit copies
    ff = FT.prepare(_ratings(spark, rows), partitions=7)
    assert _expand(ff) == _brute(rows)


def test_properties(spark):
    from affinity.catalog import ratings
    from tests.conftest import SF_SMALL

    ff = FT.prepare(ratings(spark, SF_SMALL))
    m = ff.matrix()
    n = ff.rows.count()
    per_row = m.groupBy("row", "cat").count().groupBy("cat").agg({"count": "max"}).collect()
    maxima = {r[0]: r[1] for r in per_row}
    assert maxima["user"] == maxima["item"] == maxima["label"] == 1 and maxima["context_numerical"] == 2
    assert m.where("cat = 'label'").count() == n
    sets = ff.rated_block().groupBy("user_row").agg({"value": "sum"}).collect()
    assert all(abs(r[1] - 1.0) < 1e-9 for r in sets)
    lay = ff.layout().first()
    assert m.agg({"col": "max"}).first()[0] < lay.users + 3 * lay.items + 3


def test_empty_ratings(spark):
    ff = FT.prepare(_ratings(spark, []))
    assert ff.matrix().count() == 0 and ff.rated_block().count() == 0
    assert FT.observation_interval(_ratings(spark, [])).first()[0] is None


def test_day_boundary(spark):
    rows = [("s", "u", "a", 5.0, 1000, 7), ("s", "u", "b", 5.0, 1000 + DAY - 1, 7), ("s", "u", "c", 5.0, 1000 + DAY, 7)]
    ff = FT.prepare(_ratings(spark, rows))
    days = sorted(r.value for r in ff.time_block().collect())
    assert days == [0.0, 0.0, 1.0]


def test_entry_count_and_input_order(spark):
    from pyspark.sql import functions as F

    from affinity.catalog import ratings
    from tests.conftest import SF_SMALL

    r = ratings(spark, SF_SMALL)
    ff = FT.prepare(r)
    n, users = ff.rows.count(), ff.users.count()
    # implicit ratings: one per (user, item), so only each user's first rating lacks a predecessor
    assert ff.matrix().count() == 6 * n - users
    assert ff.rated_block().count() == n
    shuffled = FT.prepare(r.repartition(7, F.rand(3)))
    assert sorted(map(tuple, shuffled.matrix().collect())) == sorted(map(tuple, ff.matrix().collect()))
    assert sorted(map(tuple, shuffled.rated_block().collect())) == sorted(map(tuple, ff.rated_block().collect()))


def test_index_tables_equal_separate_indexes(spark):
    from affinity.catalog import ratings
    from tests.conftest import SF_SMALL

    r = ratings(spark, SF_SMALL)
    users, items = FT.index_tables(r)
    assert sorted(map(tuple, users.collect())) == sorted(map(tuple, FT.user_index(r).collect()))
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, FT.item_index(r).collect()))
    # the matrix's user numbers are the user index
    ff = FT.prepare(r)
    urows = {(x.row, x.col) for x in ff.user_block().collect()}
    by_rank = {x.row: x.urow for x in ff.rows.collect()}
    assert all(by_rank[row] == col for row, col in urows)
    assert {x.urow for x in ff.rows.collect()} == {u.row for u in users.collect()}


def test_sf001_counts_match_the_full_layout(spark):
    """Expanded, the factored matrix has the entry count of the full layout."""
    from pyspark.sql import functions as F

    from affinity.catalog import ratings
    from tests.conftest import SF_CHECK

    ff = FT.prepare(ratings(spark, SF_CHECK))
    m = ff.matrix()
    per_user_sq = ff.rated_block().groupBy("user_row").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert (ff.rows.count(), ff.n_users, ff.n_items) == (2727, 150, 20)
    assert m.count() + per_user_sq == 66023  # sum over users of n(n + 6), minus one per user
    assert m.where("cat = 'context_categorical'").count() == 2577
    assert m.agg(F.max("col")).first()[0] == 212


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.just("s"), st.sampled_from(["a", "b", "hot"]), st.sampled_from(["x", "y", "z"]),
                               st.sampled_from([1.0, 2.0]), st.integers(0, 3).map(lambda d: d * DAY // 2),
                               st.sampled_from([1, 3, 7])), min_size=1, max_size=30),
       partitions=st.integers(1, 9))
def test_matrix_random(spark, rows, partitions):
    assert _expand(FT.prepare(_ratings(spark, rows), partitions=partitions)) == _brute(rows)


def test_output_schemas(spark):
    rows = [("s", "u1", "x", 5.0, 0, 7), ("s", "u1", "y", 60.0, 2 * DAY, 3)]
    ff = FT.prepare(_ratings(spark, rows))

    def typed(df):
        return [(f.name, f.dataType) for f in df.schema.fields]

    assert typed(ff.matrix()) == typed_schema(schemas.FEATURE_ENTRY)
    assert typed(ff.rated_block()) == typed_schema(schemas.RATED_SET_ENTRY)
    assert typed(ff.users) == typed_schema(schemas.USER_INDEX)
    assert typed(ff.items) == typed_schema(schemas.ITEM_INDEX)


def typed_schema(struct):
    return [(f.name, f.dataType) for f in struct.fields]
