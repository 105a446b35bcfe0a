"""Training-data operators (mixing, near-duplicates, toxicity, search, ...).

Every operator lives in a module of this subpackage together with its query
(``opN_<name>``) and, where SQL can state it, its DuckDB twin.  Nothing else in
the library imports this subpackage; ``load_all`` registers the queries.
"""

from hearth.llm.registry import ORACLE, QUERIES, load_all

__all__ = ["ORACLE", "QUERIES", "load_all"]
