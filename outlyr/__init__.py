"""outlyr: a Spark-native batch engine for finding, scoring, grouping and ranking localised outliers."""

__version__ = "0.1.0"
