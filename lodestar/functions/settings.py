"""Validated session options. All of them leave results as they are; the conf itself would take any value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PREFIX = "spark.lodestar."
# Log levels and what Spark calls them.
LEVELS = {"TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "WARNING": "WARN", "WARN": "WARN", "ERROR": "ERROR", "FATAL": "FATAL", "OFF": "OFF"}


@dataclass(frozen=True)
class Option:
    default: object
    parse: Callable[[SparkSession, object], object]
    about: str


def _level(spark: SparkSession, value: object) -> str:
    level = str(value).upper()
    if level not in LEVELS:
        raise ValueError(f"Unknown log_level: {value}")
    spark.sparkContext.setLogLevel(LEVELS[level])
    return level


def _number(name: str, low: int, high: Callable[[SparkSession], int] | None = None) -> Callable[[SparkSession, object], int]:
    def parse(spark: SparkSession, value: object) -> int:
        try:
            n = int(str(value))
        except ValueError as e:
            raise ValueError(f"{name} must be a whole number, not {value!r}") from e
        most = high(spark) if high else None
        if n < low or (most is not None and n > most):
            raise ValueError(f"{name} must be at least {low}" + (f" and at most {most}" if most is not None else ""))
        return n

    return parse


def _flag(spark: SparkSession, value: object) -> bool:
    text = str(value).lower()
    if text not in ("true", "false", "1", "0", "on", "off"):
        raise ValueError(f"not a boolean: {value!r}")
    return text in ("true", "1", "on")


def _text(spark: SparkSession, value: object) -> str:
    return str(value)


OPTIONS = {
    "logging_level": Option("ERROR", _level, "what the engine and Spark log"),
    "scheduler_num_streams": Option(0, _number("scheduler_num_streams", 1, lambda s: s.sparkContext.defaultParallelism), "scan tasks at a time, 1 to the parallelism; 0, never set: all"),
    "scheduler_queue_depth": Option(0, _number("scheduler_queue_depth", 1), "requests in a queue; 0, never set: as many as fit"),
    "prefetch_depth": Option(2, _number("prefetch_depth", 0), "row groups in flight for each worker; 0 reads one after another"),
    "enable_yield": Option(True, _flag, "whether a waiting worker may leave its slot"),
    "narrow_transfer": Option(False, _flag, "whether wide integers that fit may move as narrow ones"),
    "cast_pushdown": Option(False, _flag, "whether proven integer casts may move into the scan"),
    "hosted_root": Option(None, _text, "the folder of hosted files"),
    "hosted_port": Option(18488, _number("hosted_port", 1, lambda s: 65535), "a port for hosted files; unused, as Spark reads the folder"),
}
#: An older name, counted for a whole scan.
ALIASES = {"scan_groups_in_flight": ("prefetch_depth", 16, 1)}


class Settings:
    """get, set and reset of the session's options."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def _option(self, name: str) -> Option:
        if name not in OPTIONS:
            raise KeyError(f"unknown setting {name}")
        return OPTIONS[name]

    def get(self, name: str) -> object:
        if name in ALIASES:
            held = self._spark.conf.get(PREFIX + name, None)
            return ALIASES[name][1] if held is None else int(held)
        option = self._option(name)
        held = self._spark.conf.get(PREFIX + name, None)
        if held is None:
            return option.default
        return _flag(self._spark, held) if isinstance(option.default, bool) else int(held) if isinstance(option.default, int) else held

    def set(self, name: str, value: object) -> None:
        if name in ALIASES:
            n = _number(name, ALIASES[name][2])(self._spark, value)
            self._spark.conf.set(PREFIX + name, str(n))
            return
        self._spark.conf.set(PREFIX + name, str(self._option(name).parse(self._spark, value)))

    def reset(self, name: str) -> None:
        if name not in ALIASES:
            self._option(name)
        self._spark.conf.unset(PREFIX + name)

    @contextmanager
    def held(self, values: dict[str, object]) -> Iterator[None]:
        """The options set to `values` inside, and to what they were after; queries must run inside to see them."""
        before = {name: self._spark.conf.get(PREFIX + name, None) for name in values}
        try:
            for name, value in values.items():
                self.set(name, value)
            yield
        finally:
            for name, value in before.items():
                if value is None:
                    self._spark.conf.unset(PREFIX + name)
                else:
                    self._spark.conf.set(PREFIX + name, value)

    def table(self) -> DataFrame:
        """(name, value, description) of all options."""
        rows = [(n, None if (v := self.get(n)) is None else str(v), o.about) for n, o in OPTIONS.items()]
        return self._spark.createDataFrame(rows, "name string, value string, description string")
