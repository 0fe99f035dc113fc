"""Labelled-feature analytics for multichannel, epoched time series on Spark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels are shipped to executors by value, so that no executor needs this
# package installed or on its PYTHONPATH.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
