"""trolley: basket-continuation analytics on Spark DataFrames.

Nested basket documents become basket-item rows, frequency-ordered dictionaries and a
token vocabulary, sampled hard negatives, sparse features in long form, a factorization
machine whose parameters live in a DataFrame, top-k recommendations and ROC/PR areas.
"""

__version__ = "0.1.0"
