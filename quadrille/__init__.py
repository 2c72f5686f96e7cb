"""quadrille: a Spark-first analytics engine for tiled displacement histories."""

__version__ = "0.1.0"
