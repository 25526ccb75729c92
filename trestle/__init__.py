"""Trestle: project-document and supply-control analytics on PySpark DataFrames."""
