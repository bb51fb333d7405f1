"""Sources and sinks of the grid engine.  What runs in Python workers is pickled by value, so they need no copy of the package."""

import sys

from pyspark import cloudpickle

import gridloom.functions

for _module in (sys.modules[__name__], gridloom.functions):
    cloudpickle.register_pickle_by_value(_module)
