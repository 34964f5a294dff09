"""textquarry: document analytics and retrieval operators for PySpark.

Every operator takes and returns DataFrames.  ``operators`` holds the relational
operators, ``functions`` column expressions, ``sources`` readers and writers,
``plans`` whole pipelines and ``streaming`` the Structured Streaming jobs.
"""

__version__ = "0.1.0"
