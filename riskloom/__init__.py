"""riskloom: corporate credit-risk analytics on Spark DataFrames.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame ->
DataFrame steps), ``sources`` (schemas, scans, sinks), ``plans`` (end-to-end
flows, derived test inputs, query catalog), ``streaming`` (none needed).
"""

__version__ = "0.1.0"
