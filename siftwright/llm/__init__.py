"""Operators for preparing language-model training data. Nothing else in the package imports this subpackage."""

import os

# The driver's matrices are small; threads of a linear-algebra library would only wait for cores that executors use.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
