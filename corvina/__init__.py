"""corvina: a Spark-native search and analytics engine for web corpora.

Every operator is a pure function from DataFrames to DataFrames.  Nothing keeps state between calls; times that
matter to a result are arguments.  The optional subpackage ``corvina.llm`` holds the operators for training data
and is imported by nothing else in the package.
"""

__version__ = "0.1.0"
