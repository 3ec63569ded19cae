"""Functions given to Spark's Python operators, loaded by a Python that cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql.pandas import group_ops, map_ops

_OPERATORS = [
    (map_ops.PandasMapOpsMixin, "mapInArrow"),
    (map_ops.PandasMapOpsMixin, "mapInPandas"),
    (group_ops.PandasGroupedOpsMixin, "applyInArrow"),
    (group_ops.PandasGroupedOpsMixin, "applyInPandas"),
    (group_ops.PandasCogroupedOps, "applyInArrow"),
]


def record(monkeypatch) -> list:
    """List that gets every function given to an operator from now on."""
    functions: list = []
    for owner, name in _OPERATORS:

        def kept(self, func, *args, _before=getattr(owner, name), **named):
            functions.append(func)
            return _before(self, func, *args, **named)

        monkeypatch.setattr(owner, name, kept)
    return functions


def load_elsewhere(functions: list, folder) -> None:
    """Load the functions as a worker does, from another folder and without PYTHONPATH."""
    file = folder / "functions"
    file.write_bytes(cloudpickle.dumps(functions))
    code = (
        "import pickle, sys; sys.path = [p for p in sys.path if p]; "
        # workers get broadcasts' values apart from the functions
        "import pyspark.core.broadcast as b; b._from_id = lambda number: None; "
        "assert pickle.load(open(sys.argv[1], 'rb')); "
        "assert not any(m.split('.')[0] == 'flowlens' for m in sys.modules)"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(file)], cwd=folder, env=environment, check=True)
