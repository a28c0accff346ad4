"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, reads only the columns
it names and returns a DataFrame; extra columns, whatever their names, are ignored.
"""
