"""Training-data operators. Nothing outside this subpackage imports it."""

import tessera.llm as _self
from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_self)
