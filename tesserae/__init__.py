"""Declarative, reproducible synthetic data compiled to Spark column expressions."""

from .errors import EngineError
from .functions.distributions import Custom, Logarithmic, Multi, Normal, Skew, Triangular, Uniform
from .operators.adapters import Adapter, conforms, drive, to_constraints, to_json_schema, to_struct_type
from .operators.instance import Maker, Instance, Layered, initialize, layer
from .plans.bounds import Bound, effective_discrete, exclusive, to_bound
from .plans.compiler import ProduceContext, Trace
from .plans.kinds import OMITTED, Registry, Schema, registry, whole_value

__all__ = [
    "OMITTED", "Adapter", "Bound", "Custom", "EngineError", "Maker", "Instance", "Layered", "Logarithmic", "Multi", "Normal", "ProduceContext", "Registry",
    "Schema", "Skew", "Trace", "Triangular", "Uniform", "conforms", "drive", "effective_discrete", "exclusive", "initialize", "layer", "registry", "to_bound", "to_constraints",
    "to_json_schema", "to_struct_type", "whole_value",
]
