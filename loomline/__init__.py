"""loomline: language-model data preparation and evaluation as Spark DataFrame operators."""

__all__ = ["session"]
