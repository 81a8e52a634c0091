"""larder: a PySpark analytics library for longitudinal nutrition data and text corpora."""
