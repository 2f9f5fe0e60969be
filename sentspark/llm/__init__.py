"""Operators for preparing language-model training data.

One module per operator; ``catalog`` holds one registered query per operator
and ``oracle`` the DuckDB SQL for those that SQL can express.
"""
