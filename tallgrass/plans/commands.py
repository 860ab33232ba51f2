"""Requests as JSON: the fluent calls as a list of commands, checked against a role."""

from __future__ import annotations

import base64
import datetime as dt
import json
from enum import IntEnum
from typing import Any

from ..errors import PermissionDenied, TableError
from ..operators.aggregates import Aggregate
from ..operators.query import Query
from .predicate import Compare, Junction, Node


class Role(IntEnum):
    READER = 1
    WRITER = 2
    ADMIN = 3


NEEDS = {
    **dict.fromkeys(["where", "between", "intersect", "search", "searchpartial", "searchtimelimited", "or", "order", "orderdesc", "skip", "take", "select", "selectstatistics", "selectgrouped", "count", "getids", "last", "getqueue", "status"], Role.READER),
    **dict.fromkeys(["save", "update", "delete", "increment", "increment2", "queue"], Role.WRITER),
    **dict.fromkeys(["propertyindex", "removepropertyindex", "groupindex", "removegroupindex", "replicate"], Role.ADMIN),
}


def _value(x: Any) -> Any:
    if isinstance(x, dt.datetime):
        return {"t": "datetime", "v": x.isoformat()}
    if isinstance(x, (bytes, bytearray)):
        return {"t": "binary", "v": base64.b64encode(x).decode()}
    return x


def _back(x: Any) -> Any:
    if isinstance(x, dict) and set(x) == {"t", "v"}:
        return dt.datetime.fromisoformat(x["v"]) if x["t"] == "datetime" else base64.b64decode(x["v"])
    return x


def encode_node(node: Node) -> Any:
    if isinstance(node, Compare):
        return [node.op, node.column, _value(node.value)]
    if isinstance(node, Junction):
        return [node.op, *map(encode_node, node.parts)]
    raise TableError("only comparisons can be sent in where")


def decode_node(x: Any) -> Node:
    if x[0] in ("and", "or"):
        return Junction(x[0], tuple(map(decode_node, x[1:])))
    if x[0] not in ("==", "!=", "<", "<=", ">", ">="):
        raise TableError("only and and or operators are supported in where")
    return Compare(x[0], x[1], _back(x[2]))


def dumps(commands: list[dict[str, Any]]) -> str:
    return json.dumps(commands, default=lambda x: encode_node(x) if isinstance(x, Node) else _value(x))


def run(target: Any, request: str, role: Role = Role.ADMIN, queue: Any = None) -> Any:
    """Execute a request on a table (or on a query, if it only reads).

    Each command is ``{"do": name, ...arguments}``; the last one gives the result.
    """
    commands = json.loads(request)
    for c in commands:
        need = NEEDS.get(c["do"])
        if need is None:
            raise TableError(f"unknown command {c['do']}")
        if role < need:
            raise PermissionDenied("insufficient permissions for the user")
    q = target if isinstance(target, Query) else target.query()
    at: Any = q
    for c in commands:
        do = c["do"]
        if do == "where":
            at = at.where(decode_node(c["condition"]))
        elif do == "between":
            at = at.between(c["column"], _back(c["low"]), _back(c["high"]), c.get("bounds", "[]"))
        elif do == "intersect":
            at = at.intersect(c.get("column"), [_back(v) for v in c["values"]])
        elif do == "search":
            at = at.search(c["column"], c["query"], c.get("start_step"), c.get("steps"))
        elif do == "searchpartial":
            at = at.search_partial(c["column"], c["query"])
        elif do == "searchtimelimited":
            at = at.search_time_limited(c["column"], c["query"], c["max_ms"])
        elif do == "or":
            at = at.or_()
        elif do in ("order", "orderdesc"):
            at = at.order_by(c["column"], do == "orderdesc")
        elif do in ("skip", "take"):
            at = getattr(at, do)(c["n"])
        elif do == "select":
            return at.select(*c.get("columns", []), **c.get("renamed", {})) if c.get("columns") or c.get("renamed") else at.select_entity()
        elif do == "selectstatistics":
            return at.select_with_statistics(*c.get("columns", []), **c.get("renamed", {}))
        elif do == "selectgrouped":
            outputs = {n: "Key" if x == "Key" else Aggregate(*x) for n, x in c["outputs"].items()}
            return at.group_by(c["column"], c.get("per_shard")).select(**outputs)
        elif do == "count":
            return at.count()
        elif do == "getids":
            return at.get_ids()
        elif do == "last":
            return at.last_step()
        elif do == "status":
            return target.store.status()
        elif do == "save":
            return target.save_batch([{k: _back(v) for k, v in r.items()} for r in c["items"]])
        elif do == "update":
            return target.update(c["column"], {int(i): _back(v) for i, v in c["values"].items()})
        elif do == "delete":
            return target.delete(c["ids"])
        elif do == "increment":
            return target.atomic_increment(c["column"], c["by"], c["new_item"], at, c.get("only_if"))
        elif do == "increment2":
            return target.atomic_increment_2(c["column1"], c["column2"], c["by1"], c["by2"], c["new_item"], at)
        elif do == "propertyindex":
            return target.create_property_index(c["column"])
        elif do == "removepropertyindex":
            return target.remove_property_index(c["column"])
        elif do == "groupindex":
            return target.create_group_index(c["group"], c["value"])
        elif do == "removegroupindex":
            return target.remove_group_index(c["group"], c["value"])
        elif do == "replicate":
            return target.store.replicate(c["path"])
        elif do == "queue":
            return queue.put(_back(c["item"]))
        elif do == "getqueue":
            return queue.get_all()
    raise TableError("the request has no command that gives a result")
