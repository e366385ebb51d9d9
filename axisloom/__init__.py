"""Latent-factor analytics on Spark DataFrames.

Matrices are DataFrames: dense rows ``row_id BIGINT, y ARRAY<DOUBLE>``, sparse
cells ``row_id BIGINT, col_id INT, value DOUBLE`` or sparse rows ``row_id
BIGINT, idx ARRAY<INT>, val ARRAY<DOUBLE>``.  Spark does every pass over rows;
the driver only holds arrays of model size (columns x components).
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
