"""Speech-interval analytics and training-data preparation on PySpark.

DataFrame in, DataFrame out: every operator declares a logical plan and leaves
the physical strategy to Catalyst.  Python runs only where a true sequential
fold, a suffix structure or a model forces it, and then on Arrow batches.
"""

__version__ = "0.1.0"
