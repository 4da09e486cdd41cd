"""Training-data operators (numbered 1 to 13) for large corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names,
reads only the columns it names, and returns a DataFrame.
"""
