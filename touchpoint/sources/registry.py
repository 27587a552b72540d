"""Logical table names with declared columns.

A query names its tables (``registry["web_events"]``); what stands behind a name is bound
once, as a DataFrame or a Parquet path, and checked there against the declared schema: a
missing column or another type is an error at bind time, not a wrong or failing run later.
Additional columns are let through, as tables grow. Names may be given with their project
or dataset (``project.dataset.web_events``); the last part counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from touchpoint.sources import schemas as S

DECLARED: dict[str, T.StructType] = {
    "web_events": S.EVENTS,
    "flat_events": S.FLAT_EVENTS,
    "leads": S.LEADS,
    "phone_map": S.PHONE_MAP,
    "matched_leads": S.MATCHED_LEADS,
    "user_link": S.USER_LINK,
    "clicks": S.CLICKS,
    "journey": S.JOURNEY,
    "customers": S.CUSTOMERS,
    "ads": S.ADS,
}


def mismatches(found: T.DataType, declared: T.DataType, at: str = "") -> list[str]:
    """Where ``found`` lacks something of ``declared``; nullability is not compared."""
    if isinstance(declared, T.StructType):
        if not isinstance(found, T.StructType):
            return [f"{at}: {found.simpleString()} instead of a struct"]
        own = {f.name.lower(): f.dataType for f in found.fields}
        out = []
        for f in declared.fields:
            path = f"{at}.{f.name}".lstrip(".")
            out += mismatches(own[f.name.lower()], f.dataType, path) if f.name.lower() in own else [f"{path}: missing"]
        return out
    if isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        return mismatches(found.elementType, declared.elementType, f"{at}[]")
    return [] if found == declared else [f"{at}: {found.simpleString()} instead of {declared.simpleString()}"]


class Registry:
    def __init__(self, declared: dict[str, T.StructType] | None = None):
        self.declared = DECLARED if declared is None else declared
        self.bound: dict[str, DataFrame] = {}

    @staticmethod
    def _short(name: str) -> str:
        return name.replace("`", "").rsplit(".", 1)[-1].lower()

    def bind(self, name: str, table: DataFrame) -> DataFrame:
        """Checks ``table`` against the declared columns of ``name`` and binds it."""
        short = self._short(name)
        if short not in self.declared:
            raise KeyError(f"no table {short!r} is declared")
        wrong = mismatches(table.schema, self.declared[short])
        if wrong:
            raise TypeError(f"table {short}: {'; '.join(wrong)}")
        self.bound[short] = table
        return table

    def bind_path(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        """The Parquet table at ``path``, by the types its files have."""
        return self.bind(name, spark.read.parquet(path))

    def __getitem__(self, name: str) -> DataFrame:
        short = self._short(name)
        if short not in self.bound:
            raise KeyError(f"table {short!r} is not bound")
        return self.bound[short]
