"""Functions that run inside Python workers travel with the job.

Executors need no installed copy of this package: registered modules are pickled
by value.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
