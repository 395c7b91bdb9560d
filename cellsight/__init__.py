"""cellsight: network-usage analytics on Spark DataFrames.

Every public function takes and returns DataFrames (or small Python
values derived from bounded aggregates), so the same code runs on a
laptop session and on a cluster.
"""

__version__ = "0.1.0"
