"""lodestrata: a Spark-native engine for long-term memory tables.

Tables are DataFrames, every operator is a function from DataFrames (plus
plain parameters) to a DataFrame.  Nothing here starts a Spark job on import.
"""

__version__ = "0.1.0"
