"""Training-data operations: thirteen operators over text tables, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
