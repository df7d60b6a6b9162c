"""Collects queries and oracles. A query takes a view getter: ``v(name)`` is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.fixtures import cte, duck, view
from ..sources.kept import keep, keep_bucketed
from ..sources.session import PARTITIONS, sized_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Views:
    """Views of one data folder and frames made of them, each built once."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._made, self._kept = spark, sf_dir, {}, set()

    def __call__(self, name: str) -> DataFrame:
        return self.once(name, lambda: view(self.spark, self.sf_dir, name, self))

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def keep(self, name: str, build: Callable[[], DataFrame] | None = None, by: str | None = None) -> DataFrame:
        """The frame or view ``name``, written once: for what a plan reads three times or more.

        ``by`` buckets it by a key, a file each, in as many buckets as a shuffle of the tables starts with.
        """
        if name not in self._kept:
            rows, n = self.once(name, build) if build else self(name), int(self.spark.conf.get(PARTITIONS))
            self._made[name] = keep_bucketed(rows.repartition(n, by), by, n) if by else keep(rows)
            self._kept.add(name)
        return self._made[name]


def query(body: str | None = None, *names: str, more: dict[str, str] | None = None):
    """Register a function of ``Views`` as a query, with DuckDB SQL over the named views."""

    def add(function):
        name = function.__name__

        def run(spark, sf_dir):
            return function(Views(sized_session(spark, sf_dir), sf_dir))

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if body is not None:
            ORACLES[name] = (cte(*names, more=more) if names else "") + duck(body)
        return function

    return add
