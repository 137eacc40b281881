"""vicinage: nearest-neighbour analytics on Spark DataFrames.

Every operation takes DataFrames and returns DataFrames with explicit row ids
and a deterministic ``(distance, id)`` order.
"""

__version__ = "0.1.0"
