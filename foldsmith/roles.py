"""Column roles: which column is the key, a flag, a number, a category or a label."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

LABEL_CLASS = "label_class"
LABEL_ANY = "label_any"


@dataclass(frozen=True)
class Roles:
    """What each column of a modelling table is for.

    ``ordinal_levels`` maps a category to its values in rising order, ``penalties`` lists
    (name parts, weight) pairs that scale the importance of matching features, and
    ``discard`` names category columns left out of the final feature set.
    """

    key: str
    binary: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    labels: tuple[str, str] | tuple[()] = ()
    ordinal_levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    penalties: tuple[tuple[tuple[str, ...], float], ...] = ()
    discard: tuple[str, ...] = ()

    def __post_init__(self):
        names = [self.key, *self.binary, *self.numeric, *self.categorical, *self.labels]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"columns with more than one role: {twice}")

    @property
    def inputs(self) -> tuple[str, ...]:
        return (*self.binary, *self.numeric, *self.categorical)

    @classmethod
    def from_json(cls, path: str) -> "Roles":
        """Roles from a JSON file whose keys are the fields of this class."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        for name in ("binary", "numeric", "categorical", "labels", "discard"):
            given[name] = tuple(given.get(name, ()))
        given["ordinal_levels"] = {k: tuple(v) for k, v in given.get("ordinal_levels", {}).items()}
        given["penalties"] = tuple((tuple(parts), float(weight)) for parts, weight in given.get("penalties", ()))
        return cls(**given)

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)

    def feature_schema(self) -> T.StructType:
        """Explicit schema of a feature file; nothing is inferred."""
        st = T.StructType().add(self.key, T.LongType())
        for c in (*self.binary, *self.numeric):
            st = st.add(c, T.DoubleType())
        for c in self.categorical:
            st = st.add(c, T.StringType())
        return st

    def label_schema(self) -> T.StructType:
        st = T.StructType().add(self.key, T.LongType())
        for c in self.labels:
            st = st.add(c, T.IntegerType())
        return st
