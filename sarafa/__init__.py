"""sarafa: portfolio, fundamentals and document-evidence analytics on PySpark DataFrames."""
