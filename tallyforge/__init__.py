"""Emit-and-aggregate analytics on PySpark.

``compile_program`` runs programs in the text language; ``Program`` is the same as a Python API.
"""

from .functions.builtin import BUILTIN
from .functions.registry import Registry
from .lang.compiler import compile_program
from .operators.aggregators import AGGREGATORS, aggregator
from .plans.program import Program
from .sources import readers, sinks

__all__ = ["AGGREGATORS", "BUILTIN", "Program", "Registry", "aggregator", "compile_program", "readers", "sinks"]
