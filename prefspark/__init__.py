"""prefspark: preference-data operators as Spark DataFrame plans.

Every operator is a plain function ``op(df, ...) -> DataFrame`` (or a
Column builder for the scalar functions).  Nothing is collected to the
driver; randomness is hash-seeded so results repeat across runs and
partitionings.
"""

__version__ = "0.1.0"

# Functions and classes of this package that run inside Python workers (pandas UDF bodies,
# scorer classes) are pickled by value, so executors need no installed copy of the package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - an older cloudpickle without the hook
    pass
