"""Job outputs built on first access.

A change job returns several frames; some need eager work (a reliable checkpoint, the cut
points of a distributed rank for new ids). ``LazyFrames`` builds each output only when it is
read, so asking a job for its rejects does not allocate ids, and asking the cart fold for stock
moves does not number every event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyFrames(Mapping):
    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A shared intermediate built at most once, on first use; ``built`` tells whether it was."""
    box: list[DataFrame] = []

    def get() -> DataFrame:
        if not box:
            box.append(make())
        return box[0]
    get.built = lambda: bool(box)
    return get
