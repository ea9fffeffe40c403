"""plumbline: a PySpark-native analytics engine for quality and telemetry data.

Every operator takes and returns DataFrames; Catalyst and Tungsten choose the
physical strategy.  Import from the subpackages (``operators``, ``sources``,
``functions``, ``plans``, ``streaming``); this module stays import-light.
"""

__version__ = "0.1.0"
