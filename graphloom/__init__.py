"""A property-graph analytics engine on Spark DataFrames."""

from graphloom.model import Cardinality, Direction, PropertyGraph

__all__ = ["Cardinality", "Direction", "PropertyGraph"]
