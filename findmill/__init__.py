"""findmill: code-review analytics over tables of files, findings and reports.

Every operator is a function from DataFrame to DataFrame; compose with
``DataFrame.transform``.  See README.md for the map of modules.
"""
