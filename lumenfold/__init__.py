"""lumenfold: language-model evaluation data and training corpora on Spark DataFrames."""

__version__ = "0.1.0"
