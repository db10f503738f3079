"""Training-data operators on document tables.

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` in
:mod:`axisframe.llm.queries` are what the entry module registers.
"""
