"""Queues."""
from .queue import Queue, QueueFull

__all__ = ["Queue", "QueueFull"]
