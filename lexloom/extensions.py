"""Extensions: functions that are given an ``Api`` and register sources, models and hooks with it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from types import MappingProxyType

from pyspark.sql import SparkSession

from .sources.readers import PageSource, Registry, listing_source


class Api:
    """What an extension may use: sources, model ports, hooks, the environment, a logger, and a state of its own."""

    def __init__(self, spark: SparkSession, env: Mapping[str, str] = MappingProxyType({})):
        self.spark, self.env, self.sources = spark, MappingProxyType(dict(env)), Registry()
        self.models: dict[str, Callable[[str], str | None]] = {}
        self.log = logging.getLogger("lexloom.extensions")
        self.state: dict[str, dict] = {}
        self._begin: list[Callable[[], None]] = []
        self._end: list[Callable[[], None]] = []

    def register_source(self, source: PageSource, hosts: Iterable[str], budget: int = 10_000) -> None:
        """The source can be read by its name from then on; a name is given once."""
        self.sources.add(source, hosts)
        self.spark.dataSource.register(listing_source(source.name, source, budget))

    def register_model(self, name: str, model: Callable[[str], str | None]) -> None:
        if name in self.models:
            raise ValueError(f"two models named {name}")
        self.models[name] = model

    def on_startup(self, hook: Callable[[], None]) -> None:
        self._begin.append(hook)

    def on_shutdown(self, hook: Callable[[], None]) -> None:
        self._end.append(hook)

    def __enter__(self) -> Api:
        for hook in self._begin:
            hook()
        return self

    def __exit__(self, *_) -> None:
        """The last one registered ends first; one that fails does not keep the others from ending."""
        self.sources.close()
        for hook in reversed(self._end):
            try:
                hook()
            except Exception:  # noqa: BLE001  told, and the next one is run
                self.log.exception("a shutdown hook failed")


def load(api: Api, extensions: Mapping[str, Callable[[Api], None]]) -> list[str]:
    """Run the extensions in the order of their names; those that fail are told and left out.  Returns the names of the others."""
    done = []
    for name in sorted(extensions):
        api.state.setdefault(name, {})
        try:
            extensions[name](api)
            done.append(name)
        except Exception:  # noqa: BLE001  one broken extension stops no other
            api.log.exception("extension %s failed", name)
    return done
