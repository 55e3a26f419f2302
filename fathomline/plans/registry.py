"""Named parts that a configuration can choose: datasets, embedders, graph builders and graph stores."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Factories by name; an unknown name is an error that lists the known ones, as is a name that is taken."""

    def __init__(self, what: str):
        self.what, self.made = what, {}

    def register(self, name: str) -> Callable:
        def add(factory: Callable) -> Callable:
            if name in self.made:
                raise ValueError(f"{self.what} {name} is registered already")
            self.made[name] = factory
            return factory

        return add

    def create(self, name: str, *args, **options):
        if name not in self.made:
            raise ValueError(f"unknown {self.what}: {name}; there are {sorted(self.made)}")
        return self.made[name](*args, **options)


DATASETS, EMBEDDERS, GRAPHS, STORES = Registry("dataset"), Registry("embedder"), Registry("graph builder"), Registry("graph store")
