"""Spark-native batch analytics for payment disputes.

Layers: ``sources`` (inputs, catalog I/O), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(pipeline composition, training step, query catalog, SQL oracle).
"""

__version__ = "0.1.0"
