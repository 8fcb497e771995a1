"""Training-data operators.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
``folioflow.llm.queries`` only if the subpackage is there.
"""
