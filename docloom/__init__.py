"""Document analytics on Spark: dictionary-style queries compiled into DataFrame plans."""

from importlib import import_module

_HOMES = {
    "functions.text": ("TextIndex",),
    "plans.filters": ("rowwise", "vectorised"),
    "plans.pipeline": ("aggregate", "predicate"),
    "sources.cursor": ("AggregationCursor", "Cursor"),
    "sources.store": ("Client", "Collection", "Database", "DeleteResult", "DuplicateKeyError", "InsertManyResult", "InsertOneResult", "Transaction", "UpdateResult", "WriteConflict"),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Names are imported when they are first used: Python workers load only what they run."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
