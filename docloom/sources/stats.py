"""Driver-side records of queries: a versioned cache of small results, timings, and hints for the layout of tables."""

from __future__ import annotations

import contextlib
import time
from collections import Counter, OrderedDict
from collections.abc import Callable, Hashable


class QueryCache:
    """LRU of results; keys hold the table's version, so a write makes old entries unreachable."""

    def __init__(self, size: int = 100):
        self.size, self.hits, self.misses, self.items, self.enabled = size, 0, 0, OrderedDict(), True

    def get(self, key: Hashable, make: Callable):
        if not self.enabled:
            return make()
        if key in self.items:
            self.hits += 1
            self.items.move_to_end(key)
            return self.items[key]
        self.misses += 1
        self.items[key] = value = make()
        while len(self.items) > self.size:
            self.items.popitem(last=False)
        return value

    def clear(self) -> None:
        self.items.clear()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.items), "max_size": self.size, "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}


def shape(spec: dict) -> tuple:
    """A filter without its values: fields and operators."""
    out = []
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            out.append((k, tuple(shape(s) for s in v)))
        else:
            out.append((str(k), tuple(sorted(map(str, v))) if isinstance(v, dict) else ("$eq",)))
    return tuple(sorted(out, key=repr))


def fields_of(spec: dict) -> list[str]:
    out = []
    for k, v in spec.items():
        if isinstance(k, str) and not k.startswith("$"):
            out.append(k)
        elif isinstance(v, list):
            out += [f for s in v if isinstance(s, dict) for f in fields_of(s)]
    return out


class Recorder:
    """What was asked, how often, and how long actions took."""

    def __init__(self, slow_s: float = 0.1, most: int = 1000):
        self.slow_s, self.most, self.shapes, self.seconds, self.fields, self.slow = slow_s, most, Counter(), Counter(), Counter(), []

    @contextlib.contextmanager
    def timed(self, kind: str, spec: dict):
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            key = kind, shape(spec)
            self.shapes[key] += 1
            self.seconds[key] += took
            self.fields.update(fields_of(spec))
            if took > self.slow_s:
                self.slow = [*self.slow[1 - self.most :], {"kind": kind, "filter": spec, "seconds": took}]

    def patterns(self) -> list[dict]:
        """Shapes of queries, the most frequent first."""
        return [{"kind": kind, "shape": what, "count": n, "seconds": self.seconds[kind, what]} for (kind, what), n in self.shapes.most_common()]

    def suggestions(self, least: int = 3) -> list[str]:
        """Fields that are filtered on often: sort or bucket the table by them, so that Parquet statistics prune."""
        return [f"sort or bucket by {f} ({n} filters)" for f, n in self.fields.most_common() if n >= least]
