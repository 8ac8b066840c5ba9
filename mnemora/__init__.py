"""Spark-native associative retrieval, memory analytics and corpus preparation.

Every operator is a ``DataFrame -> DataFrame`` function; nothing runs until the
caller asks for a result, except where an operator keeps state in a table.
"""

__version__ = "0.1.0"
