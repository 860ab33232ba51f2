"""Query operators."""
from .aggregates import avg, count, count_distinct, max_, min_, sum_
from .query import Query

__all__ = ["Query", "avg", "count", "count_distinct", "max_", "min_", "sum_"]
