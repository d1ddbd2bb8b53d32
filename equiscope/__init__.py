"""equiscope — pay-equity and model-audit analytics as Spark jobs."""

import sys

try:  # ship our Python helpers inside pickled UDF closures (no executor install needed)
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark without by-value pickling
    pass

__version__ = "0.1.0"
