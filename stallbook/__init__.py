"""Market-price and advisory-text analytics as PySpark DataFrame operators.

Every operator takes DataFrames and plain parameters and returns a DataFrame
covering all keys at once; callers filter the result instead of calling once
per key.
"""

__version__ = "0.1.0"
