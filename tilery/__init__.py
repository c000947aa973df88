"""tilery: turns short utterances into tiled sequences of semantic tokens, on Spark DataFrames.

Functions of this package run inside Arrow workers; they are pickled by value, so executors need
no copy of the package on their path.
"""

from pyspark import cloudpickle as _cloudpickle

import tilery as _self

_cloudpickle.register_pickle_by_value(_self)
