"""Spark-native operators for labelled-sentence tables.

Sub-packages: ``sources`` (readers, sinks, run settings), ``functions`` (column
expressions), ``operators`` (DataFrame-to-DataFrame jobs), ``plans`` (the three
end-to-end runs, the table binding and the registered queries).
"""
