"""Training-data pipeline operators.

Nothing else in the library imports this package; it needs only the Python
standard library, numpy, pyarrow and PySpark (plus pyahocorasick for
decontamination and tokenizers for packing).
"""
