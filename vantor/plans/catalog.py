"""Names: collections as temporary views, and aliases that can be moved from one to another."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from vantor.operators.errors import CollectionExists, CollectionNotFound, InvalidInput


class Aliases:
    """Alias to collection name. Setting and swapping both replace and give back the old target."""

    def __init__(self) -> None:
        self.targets: dict[str, str] = {}

    def set(self, alias: str, target: str) -> str | None:
        if not alias:
            raise InvalidInput("an alias needs a name")
        old, self.targets[alias] = self.targets.get(alias), target
        return old

    swap = set

    def get(self, alias: str) -> str | None:
        return self.targets.get(alias)

    def remove(self, alias: str) -> str | None:
        return self.targets.pop(alias, None)

    def clear(self) -> None:
        self.targets.clear()

    def __contains__(self, alias: str) -> bool:
        return alias in self.targets

    def __len__(self) -> int:
        return len(self.targets)

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return iter(sorted(self.targets.items()))

    def __str__(self) -> str:
        return ", ".join(f"{a} -> {t}" for a, t in self)


class Catalog:
    """Collections and aliases of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.aliases, self.names = spark, Aliases(), set()

    def create(self, name: str, rows: DataFrame, *, replace: bool = False) -> None:
        if name in self.names and not replace:
            raise CollectionExists(name)
        rows.createOrReplaceTempView(name)
        self.names.add(name)

    def table(self, name: str) -> DataFrame:
        """A collection by its name or an alias."""
        target = self.aliases.get(name) or name
        if target not in self.names:
            raise CollectionNotFound(name)
        return self.spark.table(target)

    def listed(self) -> DataFrame:
        """(alias, target)."""
        return self.spark.createDataFrame(list(self.aliases), "alias string, target string")
