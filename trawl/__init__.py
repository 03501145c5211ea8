"""trawl: corpus search, snippets, reports and elaboration as Spark DataFrame transforms.

A corpus is any DataFrame with ``path STRING`` and ``text STRING`` columns (plus an
optional ``mtime DOUBLE``).  A search turns it into a findings table with exact line
and column positions and highlighted context snippets.
"""

from trawl.model import FINDING_COLUMNS, Query
from trawl.operators.query_table import search_query_table
from trawl.plans.search import search, search_many

__all__ = ["Query", "FINDING_COLUMNS", "search", "search_many", "search_query_table"]
