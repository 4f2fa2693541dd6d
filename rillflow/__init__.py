"""rillflow: network-flow analytics and sketches as PySpark DataFrame plans."""

__version__ = "0.1.0"
