"""Reference energies from a remote service, as a data source of Spark.

    spark.dataSource.register(HullSource)
    spark.read.format("hull").option("url", ...).option("formulas", '["NaCl", "LiFePO4"]').load()

The service answers GET <url>?formula=..&energy_above_hull_min=..&energy_above_hull_max=..&_skip=..&_limit=.. with
JSON: data, a list of objects with energy_per_atom and energy_above_hull, and meta.total_doc, how many there are.
Formulas are dealt to partitions, so executors ask for them side by side; each formula is read page by page, and a
page that fails is asked for again after a wait that doubles. A formula that still fails yields no rows at all, never
a part of its pages, and the log says so: its scores then fall back on other references. With push=true, which needs
spark.sql.python.filterPushdown.enabled, filters on formula (equality, membership) restrict what is asked for, and
bounds of energy_above_hull go to the service; else Spark filters what is read.

Options: url; formulas, a JSON list (repeated ones count once; its size is bound by the number of targets); page_size
(100); partitions (8); attempts (4); wait_ms (200); timeout_s (30); push; key, sent as X-API-KEY. Without a url, or without
formulas, there are no rows. Null formulas and energies that are no numbers are left out.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Entries this near to the hull count as stable.
NEAR_HULL = (0.0, 0.001)


class HullSource(DataSource):
    """Entries near the hull by formula."""

    @classmethod
    def name(cls) -> str:
        return "hull"

    def schema(self) -> str:
        return "formula string, energy_per_atom double, energy_above_hull double"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return FilteringHullReader(options) if options.get("push") == "true" else HullReader(options)


class Formulas(InputPartition):
    def __init__(self, formulas: list[str]):
        super().__init__(formulas)
        self.formulas = formulas


class HullReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda k, default: options.get(k, default)
        self.url, self.key = get("url", ""), get("key", "")
        self.formulas = sorted({x for x in json.loads(get("formulas", "[]")) if x is not None})
        self.page, self.parts, self.attempts = int(get("page_size", "100")), int(get("partitions", "8")), int(get("attempts", "4"))
        self.wait, self.timeout = int(get("wait_ms", "200")) / 1000, float(get("timeout_s", "30"))
        self.above = list(NEAR_HULL)

    def partitions(self) -> Sequence[InputPartition]:
        dealt = [self.formulas[k :: self.parts] for k in range(self.parts)] if self.url else []
        return [Formulas(x) for x in dealt if x] or [Formulas([])]

    def read(self, partition: Formulas) -> Iterator[tuple]:
        for formula in partition.formulas:
            try:
                rows = list(self._entries(formula))
            except Exception as e:  # noqa: BLE001  a service that fails gives no references
                logging.getLogger(__name__).warning("no reference for %s: %s", formula, e)
                continue
            yield from rows

    def _entries(self, formula: str) -> Iterator[tuple]:
        at = 0
        while True:
            body = self._asked({"formula": formula, "energy_above_hull_min": self.above[0], "energy_above_hull_max": self.above[1], "_skip": at, "_limit": self.page})
            data = body["data"]
            for x in data:
                energy = x.get("energy_per_atom")
                if isinstance(energy, (int, float)):
                    yield formula, float(energy), float(x.get("energy_above_hull") or 0.0)
            at += len(data)
            if not data or at >= int(body["meta"]["total_doc"]):
                return

    def _asked(self, query: dict) -> dict:
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(query)}", headers={"X-API-KEY": self.key} if self.key else {})  # noqa: S310
        for k in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                    return json.loads(answer.read())
            except Exception:
                if k == self.attempts - 1:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError


class FilteringHullReader(HullReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on formula whole; passes bounds of energy_above_hull on and lets Spark check them again."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "formula" and isinstance(f, EqualTo):
                self.formulas = [x for x in self.formulas if x == f.value]
            elif column == "formula" and isinstance(f, In):
                self.formulas = [x for x in self.formulas if x in f.value]
            else:
                if column == "energy_above_hull" and isinstance(f, (LessThan, LessThanOrEqual)):
                    self.above[1] = min(self.above[1], float(f.value))
                elif column == "energy_above_hull" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.above[0] = max(self.above[0], float(f.value))
                yield f


def remote_hull(spark: SparkSession, formulas: DataFrame, url: str, **options: str) -> DataFrame:
    """(formula, hull_energy): the least energy near the hull of each formula of a table; those that the service
    does not know, or does not answer for, are absent. The distinct formulas are targets of a run, a few."""
    spark.dataSource.register(HullSource)
    names = [r[0] for r in formulas.select("formula").where("formula is not null").distinct().collect()]
    found = spark.read.format("hull").options(url=url, formulas=json.dumps(names), **options).load()
    return found.groupBy("formula").agg(F.min("energy_per_atom").alias("hull_energy"))
