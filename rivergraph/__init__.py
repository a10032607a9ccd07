"""River-network preprocessing and training-text operators on Spark DataFrames."""

from rivergraph.operators.cells import hand as compute_hand
from rivergraph.operators.cells import ltnd as compute_ltnd
from rivergraph.operators.routing import flow_directions as compute_flow_directions

__all__ = ["compute_flow_directions", "compute_hand", "compute_ltnd"]
