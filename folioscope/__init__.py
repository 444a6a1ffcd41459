"""Folioscope: document analytics on PySpark, from recognised text blocks to training-data tables."""
