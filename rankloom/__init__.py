"""rankloom — Spark-native interaction ranking.

Batch and streaming jobs over user–item interaction tables: validation and
ingest, chronological splits, bias/SVD, content, temporal-context and neural
scorers, score fusion with grid-searched weights, ranking metrics and
explanations. Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise this package's functions by value so executors need no install of it."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
