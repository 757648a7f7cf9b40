"""Analysis of how automatic classifiers label text messages, on Spark.

Everything is a plain function over ``DataFrame`` or ``Column``:

* ``sources``   readers and writers (parquet trees, pipe tables, raw mail)
* ``functions`` column expressions (text, labels, keys, scaling, vectors)
* ``operators`` frame-level work (votes, metrics, sampling, positions)
* ``learning``  embeddings, projection, clustering, classifiers
* ``plans``     whole reports and the registered queries
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel whole, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
