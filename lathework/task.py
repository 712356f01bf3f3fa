"""A table with roles: which columns are features and target, which rows are in use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("feature", "target", "name", "order", "stratum", "group", "weight")


@dataclass(frozen=True)
class Task:
    """``row_id`` identifies rows; every other column has one role, feature unless
    ``roles`` says otherwise."""

    df: DataFrame
    row_id: str
    roles: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for column, role in self.roles.items():
            if role not in ROLES:
                raise ValueError(f"no role {role}")
            if column not in self.df.columns:
                raise ValueError(f"no column {column}")

    def columns(self, role: str) -> list[str]:
        """Columns of a role, by name."""
        return sorted(c for c in self.df.columns if c != self.row_id and self.roles.get(c, "feature") == role)

    @property
    def features(self) -> list[str]:
        return self.columns("feature")

    @property
    def target(self) -> str | None:
        return next(iter(self.columns("target")), None)

    @property
    def kind(self) -> str:
        """regr for a numeric target, classif for another, cluster without one."""
        if self.target is None:
            return "cluster"
        return "regr" if dict(self.df.dtypes)[self.target] in ("double", "float") else "classif"

    def data(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The row id and features and targets, by name, or the given columns."""
        return self.df.select(self.row_id, *(columns or [*self.features, *self.columns("target")]))

    def filter(self, rows: DataFrame) -> Task:
        """Only rows whose id is in ``rows``; a semi join, however many there are."""
        return replace(self, df=self.df.join(rows.select(self.row_id).distinct(), self.row_id, "left_semi"))

    def where(self, condition) -> Task:
        return replace(self, df=self.df.filter(condition))

    def select(self, columns: Sequence[str]) -> Task:
        """Those of ``columns`` that are features; other roles stay."""
        kept = [c for c in self.df.columns if c == self.row_id or c in columns or self.roles.get(c, "feature") != "feature"]
        return replace(self, df=self.df.select(*kept))

    def cbind(self, other: DataFrame) -> Task:
        """Adds the columns that are new, by row id."""
        new = [c for c in other.columns if c not in self.df.columns]
        return replace(self, df=self.df.join(other.select(self.row_id, *new), self.row_id))

    def rbind(self, other: DataFrame) -> Task:
        """Adds rows; their columns must be the task's."""
        if sorted(other.columns) != sorted(self.df.columns):
            raise ValueError("columns differ")
        return replace(self, df=self.df.unionByName(other))

    def rename(self, names: dict[str, str]) -> Task:
        return replace(self, df=self.df.withColumnsRenamed(names), roles={names.get(c, c): r for c, r in self.roles.items()})

    def set_roles(self, roles: dict[str, str]) -> Task:
        """Columns with other roles; a column has one role, so that the old one goes."""
        return replace(self, roles=self.roles | roles)

    def set_row_roles(self, test: DataFrame) -> DataFrame:
        """The rows with ``row_role``: test for those whose id is in ``test``, use for the
        others. Ids that the task lacks are an error."""
        ids = test.select(F.col(self.row_id).alias("_t")).distinct()
        if not ids.join(self.df, F.col("_t") == F.col(self.row_id), "left_anti").isEmpty():
            raise ValueError("ids that the task lacks")
        out = self.df.join(ids, F.col(self.row_id) == F.col("_t"), "left")
        return out.withColumn("row_role", F.when(F.col("_t").isNull(), "use").otherwise("test")).drop("_t")

    def divide(self, test: DataFrame) -> tuple[Task, Task]:
        """The task without the rows of ``test``, and the task of those rows."""
        ids = test.select(self.row_id).distinct()
        return replace(self, df=self.df.join(ids, self.row_id, "left_anti")), self.filter(ids)

    def ordered(self) -> DataFrame:
        """The data by the order columns, ties by row id."""
        return self.df.orderBy(*self.columns("order"), self.row_id)

    def set_levels(self, column: str, levels: Sequence[str], name: str | None = None) -> Task:
        """Values of ``column`` that aren't levels become null."""
        kept = F.when(F.col(column).isin(list(levels)), F.col(column))
        return replace(self, df=self.df.withColumn(name or column, kept))

    def levels(self, column: str) -> DataFrame:
        """(level, n): the values that occur; a row a level."""
        return self.df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))

    def check_target(self) -> None:
        """An error if there is no target or it has nulls."""
        if self.target is None:
            raise ValueError("no target")
        if not self.df.filter(F.col(self.target).isNull()).isEmpty():
            raise ValueError(f"{self.target} has nulls")

    def with_df(self, df: DataFrame) -> Task:
        """The same roles, for the columns that are left."""
        return replace(self, df=df, roles={c: r for c, r in self.roles.items() if c in df.columns})

    def head(self, n: int = 5) -> DataFrame:
        return self.df.orderBy(self.row_id).limit(n)

    def tail(self, n: int = 5) -> DataFrame:
        return self.df.orderBy(F.desc(self.row_id)).limit(n)
