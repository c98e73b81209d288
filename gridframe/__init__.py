"""gridframe: Spark-native operators for energy-market time series.

Layout: ``sources`` (readers/sinks), ``functions`` (Column expressions and code
dictionaries), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(domain jobs, driver-table stand-ins, registered queries), ``streaming``.
"""

__version__ = "0.1.0"
