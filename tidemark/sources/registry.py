"""The ``Sources`` bundle: one DataFrame per source role (SRC-01).

Scenario operators take a ``Sources`` and never read storage themselves, so
the same plan runs against catalog tables, Parquet folders or the test-data
mapping. Reads are lazy; Catalyst prunes columns and pushes filters into
each scan of the final plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import SOURCE_SCHEMAS

ROLES = tuple(SOURCE_SCHEMAS)


class Sources:
    """A frame per role, as an attribute (``src.login``). A role may be given
    as a function instead, which is called when the role is first used, so a
    plan pays for the analysis of the roles that it reads and no others."""

    def __init__(self, day_partitions: dict | None = None, locations: dict | None = None,
                 **roles: DataFrame | Callable[[], DataFrame]):
        if wrong := set(roles) ^ set(ROLES):
            raise TypeError(f"roles missing or unknown: {', '.join(sorted(wrong))}")
        self._roles = roles
        # role -> (time column, day-partition column) for facts stored partitioned
        # by day; window filters then also prune partitions (see ``since``).
        self.day_partitions = dict(day_partitions or {})
        # role -> tables (names or folders) that it reads, for lineage.
        self.locations = dict(locations or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROLES:
            raise AttributeError(name)
        role = self._roles[name]
        if not isinstance(role, DataFrame):
            role = self._roles[name] = role()
        return role

    @classmethod
    def from_tables(cls, spark: SparkSession, names: dict[str, str],
                    day_partitions: dict | None = None) -> "Sources":
        """Catalog tables, e.g. ``{"account": "crm.salesforce.account", ...}``."""
        return cls(**{r: lambda r=r: _lower(spark.read.table(names[r])) for r in ROLES},
                   day_partitions=dict(day_partitions or {}), locations={r: (names[r],) for r in ROLES})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, day_partitions: dict | None = None) -> "Sources":
        """One Parquet folder per role under ``root``, read with the declared
        schema (plus the day-partition column where one is declared)."""
        day_partitions = dict(day_partitions or {})

        def read(r: str) -> DataFrame:
            schema = SOURCE_SCHEMAS[r]
            if r in day_partitions:
                schema = T.StructType(schema.fields + [T.StructField(day_partitions[r][1], T.DateType())])
            return spark.read.schema(schema).parquet(f"{root}/{r}")

        return cls(**{r: lambda r=r: read(r) for r in ROLES}, day_partitions=day_partitions,
                   locations={r: (f"{root}/{r}",) for r in ROLES})

    def with_(self, **roles) -> "Sources":
        """The same sources but for the roles given."""
        return Sources(self.day_partitions, self.locations, **{**self._roles, **roles})

    def tagged(self) -> "Sources":
        """The same frames, named so that lineage can be read from plans."""
        from tidemark.publish.lineage import tagged
        return self.with_(**{r: lambda r=r: tagged(r, getattr(self, r)) for r in ROLES})

    def items(self):
        return [(r, getattr(self, r)) for r in ROLES]

    def since(self, role: str, col: str, as_of, days: int) -> DataFrame:
        """Rows of ``role`` with ``col >= as_of - days`` (a timestamp compared
        with midnight). For a fact stored partitioned by day the same bound
        is put on the partition column, so whole partitions are pruned."""
        from tidemark.functions.dates import as_date
        lo = F.date_sub(as_date(as_of), days)
        df = getattr(self, role).filter(F.col(col) >= lo)
        if role in self.day_partitions:
            ts_col, day_col = self.day_partitions[role]
            if ts_col == col and day_col != col:
                df = df.filter(F.col(day_col) >= lo)
        return df


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
