"""The contract of sketches, and a registry of them.

A sketch of one's own has ``size``, ``build(df) -> state`` and any of ``query``,
``lookup``, ``heavy_hitters``, ``changers`` and ``decode``, all over DataFrames.
``takes`` says what build reads: "flows" (key, value, first_seen; for sketches
whose updates commute) or "records" (seq, key, value).  Keys are numbers or
bytes.  What a sketch lacks answers as ``Sketch`` does: nothing found, zero, no
rows, and one warning.  ``register`` makes a factory known by name, for the
command line and configuration files, where it is measured by whatever routines
the configuration asks for; ``parameters`` are its names there, where they
differ from the factory's.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import is_bytes

log = logging.getLogger("rillflow")


class Sketch:
    size: int = 0
    takes = "records"

    def _absent(self, what: str) -> None:
        if type(self) not in _WARNED:
            log.error("%s has no %s", type(self).__name__, what)
            _WARNED.add(type(self))

    def build(self, records: DataFrame) -> DataFrame:
        raise NotImplementedError

    def query(self, state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        self._absent("query")
        return keys.withColumn("est", F.lit(0).cast("long"))

    def lookup(self, state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
        self._absent("lookup")
        return keys.select(key).distinct().withColumn("found", F.lit(False))

    def _none(self, state: DataFrame, what: str) -> DataFrame:
        self._absent(what)
        kind = "binary" if "key" in state.columns and is_bytes(state, "key") else "long"
        return state.sparkSession.createDataFrame([], f"key {kind}, est long")

    def heavy_hitters(self, state: DataFrame, threshold: float) -> DataFrame:
        return self._none(state, "heavy_hitters")

    def changers(self, state: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
        return self._none(state, "changers")

    def decode(self, state: DataFrame) -> DataFrame:
        return self._none(state, "decode")


_WARNED: set[type] = set()
_SKETCHES: dict[str, Callable] = {}
_PARAMETERS: dict[str, dict[str, str]] = {}


def register(name: str, parameters: dict[str, str] | None = None) -> Callable:
    def add(factory: Callable) -> Callable:
        _SKETCHES[name] = factory
        _PARAMETERS[name] = parameters or {}
        return factory

    return add


def create(name: str, **parameters):
    """A sketch by name; parameters by the factory's names or the configuration's."""
    _own()
    if name not in _SKETCHES:
        raise KeyError(f"no sketch {name!r}; there are {sorted(_SKETCHES)}")
    return _SKETCHES[name](**{_PARAMETERS[name].get(k, k): v for k, v in parameters.items()})


def names() -> list[str]:
    _own()
    return sorted(_SKETCHES)


@functools.cache
def _own() -> None:
    """The sketches of this library, with the configuration format's names of parameters (fixed values)."""
    from .linear import Bloom, CountingBloom, CountMin, FlowRadar
    from .ordered import ConservativeUpdate, HashPipe, HierarchyCountMin

    register("bloom", {"num_bits": "bits", "num_hash": "count"})(Bloom)
    register("counting_bloom", {"num_cnt": "counters", "num_hash": "count", "cnt_length": "bits"})(CountingBloom)
    register("count_min")(CountMin)
    register("count_sketch")(lambda **p: CountMin(signed=True, **p))
    register("conservative_update")(ConservativeUpdate)
    register("hashpipe")(HashPipe)
    register("flowradar", {"flow_filter_bit": "filter_bits", "flow_filter_hash": "filter_hashes", "count_table_num": "table", "count_table_hash": "table_hashes"})(FlowRadar)
    register("hierarchy_count_min", {"cnt_no_ratio": "ratio", "width_cnt": "widths", "no_hash": "hashes"})(HierarchyCountMin)
