"""factloom: a provenance-first knowledge-graph engine expressed as Spark plans."""

__version__ = "0.1.0"
