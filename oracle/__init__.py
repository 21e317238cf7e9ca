"""Hand-written DuckDB SQL, one string per registered query.

Written independently of the DataFrame code (no shared expression tree), so a
match between the two is evidence, not a tautology.
"""

from .sql import ORACLE_SQL, MAPPING_SQL  # noqa: F401
