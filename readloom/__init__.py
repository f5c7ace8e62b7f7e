"""Spark-native analytics for short sequencing reads.

Relational steps are lazy DataFrame plans; graph surgery and flow
decomposition run per partition as grouped-map functions.
"""

__version__ = "0.1.0"
