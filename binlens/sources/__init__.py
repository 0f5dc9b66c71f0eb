from .tables import TABLES, table
from .fixtures import view, view_sql, with_views

__all__ = ["TABLES", "table", "view", "view_sql", "with_views"]
