"""skyfold: a Spark-native engine for aerial-survey tables, model scoring and corpus preparation.

Everything is a lazy DataFrame -> DataFrame function.  Functions that must run
in Python workers are pickled by value, so that executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names that the package offers itself; each is imported when it is first used.
_HOMES = {
    "patch_metrics": ("skyfold.operators.evaluate", "at_threshold"),
    "best_f1_threshold": ("skyfold.operators.evaluate", "best_f1"),
    "mask_metrics": ("skyfold.operators.evaluate", "mask_scores"),
    "instance_map": ("skyfold.operators.reports", "instance_map"),
    "report": ("skyfold.operators.reports", "three_levels"),
    "render": ("skyfold.sources.metrics", "run_report"),
    "family_defaults": ("skyfold.operators.guards", "family_defaults"),
    "load_head": ("skyfold.operators.guards", "load_head"),
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    import importlib

    if name not in _HOMES:
        raise AttributeError(name)
    module, attribute = _HOMES[name]
    return getattr(importlib.import_module(module), attribute)
