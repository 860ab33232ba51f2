"""Managed tables."""
from .entity import Entity
from .sharded import ShardedTable
from .store import Store, Table, Transaction

__all__ = ["Entity", "ShardedTable", "Store", "Table", "Transaction"]
