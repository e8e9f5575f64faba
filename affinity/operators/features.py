"""Feature matrix for context-aware factorization models.

From engagement ratings (``site, user, item, rating, timestamp, event``):

* dense user and item indexes (F2, F3), numbered in sorted key order;
* one matrix row per rating (F12), numbered in order of (user, time, item,
  event, rating);
* per row, entries in coordinate form ``row, col, cat, value`` (F5-F11):

  ====================  ================================  ===================
  block                 column                            value
  ====================  ================================  ===================
  active user           a + user index     ``user``       1
  active item           b + item index     ``item``       1
  item rated before     d + item index     ``context_categorical``  1
  days since start      e                  ``context_numerical``    whole days
  event                 f = e + 1          ``context_numerical``    event code
  target                f + 1              ``label``      rating
  ====================  ================================  ===================

  with a = 0, b = U, c = U + I, d = U + 2I, e = U + 3I for U users, I items;
* the rated-items block (F7): every rating of the user, at c + item index, with
  weight 1/N for N ratings of the user.  This block is the same for all rows of
  a user, so it is stored once per user (``rated_block``: ``user_row, col,
  cat, value``), as in block-structured factorization machine input, instead
  of being repeated in each of the user's N rows: a user with N ratings costs
  N entries, not N squared.  A row's set is the one whose ``user_row`` equals
  the column of the row's ``user`` entry.

The item rated before is the item of the latest earlier (time, item) of the same
user; rows with equal (time, item) share it; a user's first rating has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.plans.heavy import dealt_join, heavy_keys
from affinity.plans.materialize import materialize
from affinity.plans.sequence import dense_index, sequence

__all__ = [
    "DAY_MS",
    "observation_interval",
    "user_index",
    "item_index",
    "extend_index",
    "index_tables",
    "FeatureFrame",
    "prepare",
    "prepare_own",
    "feature_matrix",
]

# Fixed value: one day in milliseconds.
DAY_MS = 86_400_000


def observation_interval(ratings: DataFrame) -> DataFrame:
    """Earliest and latest rating time (F1): one row ``begin, end``."""
    return ratings.agg(F.min("timestamp").alias("begin"), F.max("timestamp").alias("end"))


def extend_index(known: DataFrame, keys: DataFrame, key_cols: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``known`` (numbered 0..n-1) with the keys it lacks, numbered from n in sorted order.

    Old numbers never change, so models and matrices made from earlier batches stay
    valid.  Only keys that are new are sorted and numbered.
    """
    known = known.select(*key_cols, name)
    size = known.count()
    fresh = keys.select(*key_cols).distinct().join(known.select(*key_cols), key_cols, "left_anti")
    numbered = dense_index(fresh, key_cols, name, partitions)
    return known.unionByName(numbered.withColumn(name, F.col(name) + F.lit(size)))


def user_index(ratings: DataFrame, partitions: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Distinct (site, user) numbered 0..U-1 in sorted order (F2), after those of a ``known`` index."""
    if known is not None:
        return extend_index(known, ratings, ["site", "user"], "row", partitions)
    return dense_index(ratings, ["site", "user"], "row", partitions)


def item_index(ratings: DataFrame, partitions: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Distinct item numbered 0..I-1 in sorted order (F3), after those of a ``known`` index."""
    if known is not None:
        return extend_index(known, ratings, ["item"], "col", partitions)
    return dense_index(ratings, ["item"], "col", partitions)


def index_tables(ratings: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """User and item indexes (F2, F3) numbered in one pass.

    The distinct user keys and item keys are tagged, unioned and numbered by one
    range-partitioned sequence; items then shift down by the number of users.
    Same result as ``user_index`` and ``item_index``, with one shuffle, one
    sort and one checkpoint instead of two each.
    """
    none = F.lit(None).cast("string")
    keys = (ratings.select(F.lit(0).alias("_kind"), "site", "user", none.alias("item"))
            .unionByName(ratings.select(F.lit(1).alias("_kind"), none.alias("site"), none.alias("user"), "item"))
            .distinct())
    numbered = sequence(keys, ["_kind", "site", "user", "item"], index="_idx", partitions=partitions)
    users = numbered.where(F.col("_kind") == 0).select("site", "user", F.col("_idx").alias("row"))
    n_users = users.count()  # one job over the checkpointed keys
    items = numbered.where(F.col("_kind") == 1).select("item", (F.col("_idx") - F.lit(n_users)).alias("col"))
    return users, items


@dataclass
class FeatureFrame:
    """Ratings joined to their indexes and numbered, with the block layout.

    U, I and the start time are three numbers, computed once by ``prepare``
    (one aggregate job) and used as literals, so no later action recomputes
    them and nothing is cross-joined.
    """

    indexed: DataFrame  # site, user, icol, timestamp, event, rating, _rid
    rows: DataFrame     # the same plus row, urow, prev_col
    users: DataFrame
    items: DataFrame
    n_users: int
    n_items: int
    begin: int | None

    # block offsets (columns of ``_ctx``) ------------------------------------
    @property
    def a(self) -> Column:
        return F.lit(0).cast("long")

    @property
    def b(self) -> Column:
        return F.col("_nu")

    @property
    def c(self) -> Column:
        return F.col("_nu") + F.col("_ni")

    @property
    def d(self) -> Column:
        return F.col("_nu") + F.lit(2) * F.col("_ni")

    @property
    def e(self) -> Column:
        return F.col("_nu") + F.lit(3) * F.col("_ni")

    @property
    def f(self) -> Column:
        return self.e + F.lit(1)

    def _ctx(self, df: DataFrame) -> DataFrame:
        """``df`` with U, I and the start time attached as columns."""
        return df.select("*", F.lit(self.n_users).cast("long").alias("_nu"),
                         F.lit(self.n_items).cast("long").alias("_ni"), F.lit(self.begin).cast("long").alias("_t0"))

    # entry expressions ---------------------------------------------------
    def _entry(self, col: Column, cat: str, value: Column) -> Column:
        return F.struct(col.cast("long").alias("col"), F.lit(cat).alias("cat"), value.cast("double").alias("value"))

    def _user(self):
        return self._entry(self.a + F.col("urow"), "user", F.lit(1.0))

    def _item(self):
        return self._entry(self.b + F.col("icol"), "item", F.lit(1.0))

    def _previous(self):
        return self._entry(self.d + F.col("prev_col"), "context_categorical", F.lit(1.0))

    def _time(self):
        days = F.floor((F.col("timestamp") - F.col("_t0")) / F.lit(DAY_MS))
        return self._entry(self.e, "context_numerical", days)

    def _event(self):
        return self._entry(self.f, "context_numerical", F.col("event"))

    def _label(self):
        return self._entry(self.f + F.lit(1), "label", F.col("rating"))

    def _block(self, entry: Column, where: Column | None = None) -> DataFrame:
        rows = self.rows if where is None else self.rows.where(where)
        return self._ctx(rows).select(F.col("row"), entry.alias("_e")).select("row", "_e.col", "_e.cat", "_e.value")

    # blocks --------------------------------------------------------------
    def user_block(self) -> DataFrame:
        """active user."""
        return self._block(self._user())

    def item_block(self) -> DataFrame:
        """active item."""
        return self._block(self._item())

    def previous_block(self) -> DataFrame:
        """F8: item rated just before; absent for a user's first rating."""
        return self._block(self._previous(), F.col("prev_col").isNotNull())

    def time_block(self) -> DataFrame:
        """whole days since the observation start."""
        return self._block(self._time())

    def event_block(self) -> DataFrame:
        """event code."""
        return self._block(self._event())

    def label(self) -> DataFrame:
        """the rating as target."""
        return self._block(self._label())

    def rated_block(self) -> DataFrame:
        """per user, every rated item (duplicates kept) with weight 1/N."""
        counts = self.rows.groupBy("urow").agg(F.count(F.lit(1)).alias("_n"))
        # The ratings of users who hold a large share of all are dealt over parts.
        heavy = heavy_keys(self.rows, ["urow"])
        return (self._ctx(dealt_join(self.rows, counts, ["urow"], ["row"], heavy))
                .select(F.col("urow").alias("user_row"), (self.c + F.col("icol")).cast("long").alias("col"),
                        F.lit("context_categorical_set").alias("cat"),
                        (F.lit(1.0) / F.col("_n").cast("double")).alias("value")))

    def matrix(self) -> DataFrame:
        """all per-row entries in one pass (one generator over each row)."""
        entries = F.array(self._user(), self._item(),
                          F.when(F.col("prev_col").isNotNull(), self._previous()),
                          self._time(), self._event(), self._label())
        # A missing previous item is a null element; ``inline`` turns it into a
        # null row, dropped right after (no lambda, so the generator is compiled).
        return (self._ctx(self.rows).select("row", F.inline(entries))
                .where(F.col("col").isNotNull())
                .select("row", "col", "cat", "value"))

    def layout(self) -> DataFrame:
        """one row with U, I and every block offset."""
        return (self._ctx(self.users.agg(F.count(F.lit(1)).alias("users")))
                .select("users", F.col("_ni").alias("items"), self.a.alias("user_offset"),
                        self.b.alias("item_offset"), self.c.alias("rated_offset"), self.d.alias("previous_offset"),
                        self.e.alias("time_col"), self.f.alias("event_col"), (self.f + F.lit(1)).alias("label_col")))

    def rating_rows(self) -> DataFrame:
        """ratings with their matrix row number and index columns."""
        return self.rows.select("row", "urow", "icol", "timestamp", "event", "rating")


def prepare(ratings: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None,
            partitions: int | None = None, stored: bool = False) -> FeatureFrame:
    """Index and number the ratings.

    Given indexes (``site, user, row`` and ``item, col``, numbered from 0) are
    joined, and may hold more keys than these ratings; a rating whose user or
    item is missing there fails the job.  Indexes not given are built.  Ratings
    are read several times (keys, join, start time), so unless ``stored`` says
    they already come from a written table they are checkpointed first and
    computed only once.
    """
    if not stored:
        ratings = materialize(ratings)
    if users is None or items is None:
        own_users, own_items = index_tables(ratings, partitions)
    frame = prepare_own(ratings, own_users if users is None else users, own_items if items is None else items, partitions)
    if users is not None:
        numbers = users.select("site", "user", F.col("row").alias("_given"))
        missing = F.raise_error(F.concat(F.lit("user is not in the index: "), F.col("user")))
        given = F.when(F.col("_given").isNull(), missing.cast("long")).otherwise(F.col("_given"))
        frame.rows = frame.rows.drop("urow").join(numbers, ["site", "user"], "left").withColumn("urow", given).drop("_given")
    return frame


def prepare_own(ratings: DataFrame, users: DataFrame, items: DataFrame, partitions: int | None = None) -> FeatureFrame:
    """``prepare`` for fixed ratings whose own user index is ``users``.

    The user index is the dense rank of (site, user) in the row order, so only
    the item index is joined; Spark broadcasts it if it is small.  ``_rid``
    (position in the fixed ratings) is stable when tasks rerun; it splits groups
    of identical explicit ratings over range partitions.
    """
    keyed = ratings.withColumn("_rid", F.monotonically_increasing_id())
    missing = F.raise_error(F.concat(F.lit("item is not in the index: "), F.col("item")))
    icol = F.when(F.col("col").isNull(), missing.cast("long")).otherwise(F.col("col"))
    indexed = (keyed.join(items, "item", "left")
               .select("site", "user", icol.alias("icol"), "timestamp", "event", "rating", "_rid"))
    rows = sequence(indexed, ["site", "user", "timestamp", "icol", "event", "rating"], index="row",
                    group_cols=["site", "user"], run_cols=["timestamp", "icol"], lag={"prev_col": "icol"},
                    group_index="urow", partitions=partitions, tie="_rid")
    n_users, n_items, begin = _layout_numbers(ratings, users, items)
    return FeatureFrame(indexed, rows, users, items, n_users, n_items, begin)


def _layout_numbers(ratings: DataFrame, users: DataFrame, items: DataFrame) -> tuple[int, int, int | None]:
    """U, I and the earliest rating time in one job (three tagged partial
    aggregates over a union)."""
    tagged = (users.select(F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_t"))
              .unionByName(items.select(F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_t")))
              .unionByName(ratings.select(F.lit(2).alias("_k"), F.col("timestamp").alias("_t"))))
    got = {r[0]: (r[1], r[2]) for r in tagged.groupBy("_k").agg(F.count(F.lit(1)), F.min("_t")).collect()}
    return got.get(0, (0, None))[0], got.get(1, (0, None))[0], got.get(2, (0, None))[1]


def feature_matrix(ratings: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matrix entries (F13) and rated-items sets (F7) of ``ratings``."""
    ff = prepare(ratings, partitions=partitions)
    return ff.matrix(), ff.rated_block()
