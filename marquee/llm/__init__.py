"""Training-data operators: cleaning, deduplication, mixing and packaging of text corpora.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
only when it can be imported.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package travel to the workers with the task, so executors need no copy of the library
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
