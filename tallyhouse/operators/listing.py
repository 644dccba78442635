"""A list report: filtered base table, left lookups, optional filter on looked-up columns, newest first.

``ListReport`` holds DataFrames and columns only; it decides *where* joins and limits go, Spark decides how they run.

* ``rows``: the whole relation, lookups as plain left joins (Catalyst turns the filtered ones into inner joins).
* ``page``: a lookup that no filter reads gives every row at least one result row, so the first ``n`` result rows come
  from the first ``n`` rows without it. The base is scanned once, joined only to what the filters read (usually
  nothing) and cut; the other lookup tables are then cut to the few keys on it, so they are not shuffled at all.
* ``total``: base and lookups are first counted per join key and the counts multiplied. Hot keys shrink to one row per
  task before they are shuffled, and lookups on a declared unique key that nothing else needs are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.functions.predicates import all_of, keep
from tallyhouse.operators import ranks, spread
from tallyhouse.operators.hotkeys import measured
from tallyhouse.operators.paging import (
    DEEP_PAGE,
    Order,
    first_page_rows,
    number_head,
    number_rows,
    page_bounds,
)
from tallyhouse.operators.scratch import pinned, written

Names = str | tuple[str, ...]


def _tuple(names: Names) -> tuple[str, ...]:
    return (names,) if isinstance(names, str) else names


@dataclass(frozen=True, eq=False)
class Lookup:
    """A left join of ``right`` on ``left_on == right_on``; all column names differ from those already present."""

    right: DataFrame
    left_on: Names
    right_on: Names
    # The right key is declared unique, so the join never multiplies rows.
    unique: bool = False
    # No two rows of ``right`` are equal.
    distinct: bool = False
    # Rows with the same keys that are cheaper to count than ``right``, or that have more of each key than it.
    counted: DataFrame | None = None
    # The hot keys from counters kept beside the table.
    hot: Callable[[int], Mapping[int, int] | None] | None = None
    # For lookups built by an aggregate: makes ``right`` from ``source`` already cut to the wanted ``source_on`` keys.
    build: Callable[[DataFrame], DataFrame] | None = None
    source: DataFrame | None = None
    source_on: str | None = None

    @property
    def needs(self) -> tuple[str, ...]:
        return _tuple(self.left_on)

    @property
    def keys(self) -> tuple[str, ...]:
        return _tuple(self.right_on)

    def _match(self, left: DataFrame, right: DataFrame) -> list[Column]:
        return [left[a] == right[b] for a, b in zip(self.needs, self.keys, strict=True)]

    def attach(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        right = self.right if right is None else right
        return left.join(right, self._match(left, right), "left")

    def attach_all(self, left: DataFrame) -> DataFrame:
        """Attach to a left side of any size.

        AQE splits a hot key of the left side. It cannot split the right side of a left join, so a table that may hold many
        rows of one key is spread by ``spread_join``.
        """
        if self.unique:
            return self.attach(left)
        hot = self.hot(spread.HOT_ROWS) if self.hot else None
        if hot is None:
            hot = measured(self.right if self.counted is None else self.counted, self.keys, spread.HOT_ROWS)
        return spread.spread_join(left, self.right, self.needs, self.keys, self.distinct, hot)

    def attach_for(
        self, head: DataFrame, fixed: DataFrame, upto: int, order: Sequence[str] | None
    ) -> DataFrame:
        """Attach to a head of which ``upto`` rows count, reading only the keys that ``fixed``, its pinned part, holds.

        The broadcast side is the head's distinct keys, whose number the page bounds whatever the tables hold.
        """
        names = [f"_key{i}" for i in range(len(self.needs))]
        keys = fixed.select(*[F.col(c).alias(n) for c, n in zip(self.needs, names, strict=True)]).distinct()
        for n in names:
            keys = keys.where(F.col(n).isNotNull())
        table = self.right if self.build is None else self.source
        on = self.keys if self.build is None else (self.source_on,)
        cut = table.join(
            F.broadcast(keys), [table[k] == keys[n] for k, n in zip(on, names, strict=True)], "left_semi"
        )
        right = cut if self.build is None else self.build(cut)
        if not self.unique and order is not None:
            # A page shows at most ``upto`` of the rows one key has; tasks drop the others before they shuffle.
            first = Window.partitionBy(*self.keys).orderBy(*[F.asc_nulls_first(c) for c in order or self.keys])
            right = right.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= upto).drop("_nth")
        return self.attach(head, right)


@dataclass(frozen=True, eq=False)
class ListReport:
    base: DataFrame
    order: Order
    output: Sequence[Column]
    lookups: Sequence[Lookup] = ()
    # Filters on looked-up columns: the column each one reads, and the condition or None.
    tests: Sequence[tuple[str, Column | None]] = ()
    # The part of ``order`` that reads base columns only, ending in the base key; None = all of it.
    base_order: Order | None = None

    @property
    def where(self) -> Column | None:
        return all_of(*[condition for _, condition in self.tests])

    def _tested(self) -> set[str]:
        return {name for name, condition in self.tests if condition is not None}

    def _for_tests(self) -> list[Lookup]:
        """The lookups the filters read, with those they hang on."""
        found: list[Lookup] = []
        wanted = self._tested()
        for lookup in reversed(self.lookups):
            if wanted.intersection(lookup.right.columns):
                found.insert(0, lookup)
                wanted.update(lookup.needs)
        return found

    def _joined(self, lookups: Sequence[Lookup]) -> DataFrame:
        df = self.base
        for lookup in lookups:
            df = lookup.attach_all(df)
        return keep(df, self.where)

    def joined(self) -> DataFrame:
        return self._joined(self.lookups)

    def rows(self) -> DataFrame:
        """Every row, unnumbered: needs no sort at all."""
        return self.joined().select(*self.output)

    def numbered(self, partitions: int | None = None) -> DataFrame:
        """Every row with its ``rn``; only the shown columns and the sort key are written on the way."""
        order = self.order.renamed("_sort_")
        shown = self.joined().select(*self.output, *[F.col(c).alias(f"_sort_{c}") for c in self.order.names])
        return number_rows(shown, order.columns(), partitions).drop(*order.names)

    def _own_ties(self, lookup: Lookup) -> list[str] | None:
        """The tie-breaks that order the rows of one key of ``lookup``; None when a later lookup on it has a say."""
        hanging = set(lookup.right.columns)
        for later in self.lookups:
            if later is not lookup and hanging.intersection(later.needs):
                hanging.update(later.right.columns)
        ties = [c for c in self.order.ties if c in hanging]
        return ties if set(ties) <= set(lookup.right.columns) else None

    def _head(self, upto: int) -> DataFrame:
        """The first ``upto`` joined rows with all their columns, for ``upto <= DEEP_PAGE``."""
        order = self.order.columns()
        first = self._for_tests()
        later = [lookup for lookup in self.lookups if lookup not in first]
        if not later or not all(lookup.unique for lookup in first):
            return first_page_rows(self.joined(), order, upto)
        head = fixed = pinned(first_page_rows(self._joined(first), (self.base_order or self.order).columns(), upto))
        for lookup in later:
            if not set(fixed.columns).issuperset(lookup.needs):
                # Its keys come from an earlier lookup: fix that result, or its table would be read twice. Rows that lookups
                # have multiplied are cut to the page again where their order is known by now.
                known = self.order.names if set(self.order.names) <= set(head.columns) else ()
                head = fixed = pinned(first_page_rows(head, order, upto) if known else head)
            head = lookup.attach_for(head, fixed, upto, self._own_ties(lookup))
        return first_page_rows(head, order, upto)

    def page(self, page: int = 1, row: int = 10) -> DataFrame:
        after, upto = page_bounds(page, row)
        if upto > DEEP_PAGE:
            return self.page_by_rank(page, row)
        numbered = number_head(self._head(upto), self.order.columns(), after, upto)
        return numbered.select(*self.output, "rn").orderBy("rn")

    def page_by_rank(self, page: int = 1, row: int = 10) -> DataFrame:
        """The same page by counting ranges of the sort key: its cost does not depend on how far back it lies.

        Base rows are counted with the rows that lookups make of them, on narrow keys; the base rows of the page are picked
        and only they are looked up.
        """
        after, upto = page_bounds(page, row)
        first = self._for_tests()
        later = [lookup for lookup in self.lookups if lookup not in first]
        if all(lookup.unique for lookup in first):
            found, skipped = self._base_rows(first, later, after, upto)
        else:
            # A filter reads a lookup that multiplies rows: the rows counted are those of the whole join.
            rows = self.joined()
            keys = rows.select(*self.order.names, F.lit(1).cast("bigint").alias("_rows"))
            cut = ranks.cut_for(keys, self.order, after, upto)
            found, skipped = cut.of(rows), cut.skipped
        order = self.order.renamed("_sort_")
        shown = found.select(*self.output, *[F.col(c).alias(f"_sort_{c}") for c in self.order.names])
        numbered = number_rows(shown, order.columns()).withColumn("rn", (F.col("rn") + skipped).cast("bigint"))
        return numbered.where((F.col("rn") > after) & (F.col("rn") <= upto)).drop(*order.names).orderBy("rn")

    def _base_rows(self, first: list[Lookup], later: list[Lookup], after: int, upto: int) -> tuple[DataFrame, int]:
        """The joined rows of all base rows that have rows on the page, and the number of rows in front of them."""
        order = self.base_order or self.order
        rows = self._joined(first)
        kept = self._multiplying(later, set())
        if kept:
            needed = {c for lookup in kept for c in lookup.needs}
            columns = dict.fromkeys([*order.names, *[c for c in rows.columns if c in needed]])
            start = rows.select(*columns, F.lit(1).cast("bigint").alias("_n"))
            counted = self._multiplied(start, kept, set(order.names))
            keys = written(counted.groupBy(*order.names).agg(F.sum("_n").alias("_rows")))
        else:
            keys = rows.select(*order.names, F.lit(1).cast("bigint").alias("_rows"))
        cut = ranks.cut_for(keys, order, after, upto)
        on_page = ranks.placed(cut.of(keys), order).withColumn("_before", F.col("_before") + cut.skipped)
        on_page = on_page.where((F.col("_before") < upto) & (F.col("_before") + F.col("_rows") > after))
        picked = on_page.select(*[F.col(c).alias(f"_at_{c}") for c in order.names], "_before")
        if upto - after <= DEEP_PAGE:
            picked = F.broadcast(picked)  # the keys of a page
        same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in order.names]
        head = fixed = pinned(cut.of(rows).join(picked, same).drop(*[f"_at_{c}" for c in order.names]))
        skipped = fixed.agg(F.min("_before")).first()[0] or 0
        for lookup in later:
            if not set(fixed.columns).issuperset(lookup.needs):
                head = fixed = pinned(head)
            head = lookup.attach_for(head, fixed, upto - skipped, self._own_ties(lookup))
        return head.drop("_before"), skipped

    def _multiplying(self, lookups: Sequence[Lookup], wanted: set[str]) -> list[Lookup]:
        """The lookups that decide how many rows there are: those that may multiply rows or that are read by such or by filters."""
        kept: list[Lookup] = []
        wanted = set(wanted)
        for lookup in reversed(lookups):
            if not lookup.unique or wanted.intersection(lookup.right.columns):
                kept.insert(0, lookup)
                wanted.update(lookup.needs)
        return kept

    def _multiplied(self, weighted: DataFrame, kept: Sequence[Lookup], carried_on: set[str]) -> DataFrame:
        """``weighted``, whose rows stand for ``_n`` rows each, after the lookups; keeps ``carried_on`` and what later ones need."""
        for i, lookup in enumerate(kept):
            later = carried_on.union(*[x.needs for x in kept[i + 1:]])
            carried = [c for c in lookup.right.columns if c in later and c not in lookup.keys]
            if lookup.unique:
                right = lookup.right.select(*lookup.keys, *carried, F.lit(1).cast("bigint").alias("_m"))
            else:
                right = lookup.right.groupBy(*lookup.keys, *carried).agg(F.count(F.lit(1)).alias("_m"))
            joined = lookup.attach(weighted, right)
            weighted = joined.withColumn("_n", F.col("_n") * F.coalesce("_m", F.lit(1))).drop("_m")
            if i + 1 < len(kept):
                keys = [c for c in weighted.columns if c in later]
                weighted = weighted.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        return weighted

    def total(self) -> DataFrame:
        tested = self._tested()
        kept = self._multiplying(self.lookups, tested)
        if not kept:
            return self.base.agg(F.count(F.lit(1)).alias("total"))

        wanted = tested.union(*[lookup.needs for lookup in kept])
        base_keys = [c for c in self.base.columns if c in wanted]
        weighted = self.base.groupBy(*base_keys).agg(F.count(F.lit(1)).alias("_n"))
        weighted = self._multiplied(weighted, kept, tested)
        return keep(weighted, self.where).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"))
