"""Training-data operators. Nothing outside this folder imports it.

Functions that run in Python workers are shipped by value, so executors need
no copy of the package on their path."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

_TASK_MODULES = ("quality", "langid", "rangecoder", "wrapper", "hnsw", "dartminhash", "warc", "files",
                 "vectorcodes", "runs")
for _name in _TASK_MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
