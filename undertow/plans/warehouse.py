"""The model registry, and a warehouse that resolves names to DataFrames lazily."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import pin, prepare
from ..sources.bindings import BINDINGS, bind, names_in
from ..sources.contracts import ContractError
from ..sources.tables import LANDED, scan


@dataclass(frozen=True)
class Check:
    """A data test on one column of a model."""

    kind: str  # unique, not_null or accepted
    column: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    reads: tuple[str, ...]
    build: Callable[..., DataFrame]
    # Per input, the columns whose type the model depends on: those it does arithmetic, date
    # work or ordering on. Text there would be cast silently, so a changed type must stop it.
    typed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()


MODELS: dict[str, Model] = {}


def model(layer: str, typed: str = "", key: str = "", required: str = "", accepted=None):
    """Register a model function; its parameter names are the tables it reads.

    ``typed`` lists ``table.column`` pairs, ``key`` the columns that must be unique and
    present, ``required`` those that must be present, ``accepted`` the allowed values by column.
    """

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        reads = tuple(inspect.signature(fn).parameters)
        by_table: dict[str, tuple[str, ...]] = {}
        for pair in typed.split():
            table, column = pair.split(".")
            by_table[table] = (*by_table.get(table, ()), column)
        checks = [Check("unique", c) for c in key.split()]
        checks += [Check("not_null", c) for c in (*key.split(), *required.split())]
        checks += [Check("accepted", c, tuple(v)) for c, v in (accepted or {}).items()]
        MODELS[fn.__name__] = Model(fn.__name__, layer, reads, fn, by_table, tuple(checks))
        return fn

    return register


class MissingTable(LookupError):
    """A table that a model reads does not exist in this warehouse."""


class Warehouse:
    """Names to DataFrames: landed tables, source roles and models, each built once on demand.

    ``replaced`` puts other DataFrames in place of named tables, everything downstream reading
    them; a ``None`` there means the table is gone.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        replaced: dict[str, DataFrame | None] | None = None,
        production: Warehouse | None = None,
    ):
        self.spark = prepare(spark)
        self.root = root
        self.replaced = dict(replaced or {})
        self.production = production
        self._built: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    def overlay(self, replaced: dict[str, DataFrame | None]) -> Warehouse:
        """This warehouse with some tables replaced; the rest passes through untouched.

        What has been written here is read there too, unless it is built from a replaced table.
        """
        copy = Warehouse(self.spark, self.root, {**self.replaced, **replaced}, self)
        copy._hold({name: self._built[name] for name in self._kept - _readers(set(replaced))})
        return copy

    def holding(self, written: dict[str, DataFrame]) -> Warehouse:
        """This warehouse with models that are written elsewhere: they are read there and never built."""
        copy = Warehouse(self.spark, self.root, self.replaced, self.production)
        copy._hold(written)
        return copy

    def _hold(self, written: dict[str, DataFrame]) -> None:
        self._built.update(written)
        self._kept.update(written)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.replaced:
            df = self.replaced[name]
            if df is None:
                raise MissingTable(f"{name} does not exist")
            return df
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def keep(self, name: str) -> DataFrame:
        """The table written once to the checkpoint folder; what is built from now on reads it there.

        Used where many models are built one after another, so that none computes again what
        another has computed.
        """
        if name not in self._kept:
            self._built[name] = pin(self[name], name)
            if name in self.replaced:
                self.replaced[name] = self._built[name]
            self._kept.add(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in MODELS:
            m = MODELS[name]
            inputs = {table: self[table] for table in m.reads}
            self._require_types(m, inputs)
            return m.build(**inputs)
        if name in BINDINGS:
            return bind(name, self.__getitem__)
        if name in LANDED:
            return scan(self.spark, self.root, name)
        raise MissingTable(f"no table is called {name}")

    def _require_types(self, m: Model, inputs: dict[str, DataFrame]) -> None:
        if self.production is None:
            return
        for table, columns in m.typed.items():
            now, then = inputs[table].schema, self.production[table].schema
            for column in columns:
                if column in now.names and now[column].dataType != then[column].dataType:
                    raise ContractError(
                        f"{m.name} needs {table}.{column} as {then[column].dataType.simpleString()}"
                        f", found {now[column].dataType.simpleString()}"
                    )


def _readers(tables: set[str]) -> set[str]:
    """``tables`` and every role and model that reads one of them at any depth."""
    reached, found = set(), set(tables)
    while found - reached:
        reached |= found
        found = {role for role, template in BINDINGS.items() if reached.intersection(names_in(template))}
    for name, m in MODELS.items():
        if reached.intersection(m.reads):
            reached.add(name)
    return reached


def downstream_models(origin: str) -> list[str]:
    """Every model that reads ``origin`` at any depth, upstream ones first.

    Registration order is already a build order, so one pass over it is enough.
    """
    reached = {origin}
    ordered = []
    for name, m in MODELS.items():
        if reached.intersection(m.reads):
            reached.add(name)
            ordered.append(name)
    return ordered
