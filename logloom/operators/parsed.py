"""What a family parser hands to the event mapper: expressions, each a column of its own.

A family's steps add helper columns to a DataFrame; ``Parsed`` then says how
each attribute is read from them. The mapper picks by family, so an attribute
that no one selects is never worked out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import sqltext as F
from ..functions.columns import MAP, PAIRS
from ..functions.sqltext import Sql

#: Attributes beside the values, with their types.
ATTRIBUTES = {
    "format": "string", "parser_id": "string", "source_name": "string", "product": "string", "os_family": "string", "category": "string",
    "class_uid": "int", "activity_id": "int", "activity_name": "string", "severity_id": "int", "status": "string", "status_id": "int",
    "unmapped": MAP, "n_mapped": "int", "n_fields": "int", "core": "int", "native": MAP, "confidence": "double",
    "candidates": "array<struct<parser_id:string,score:double>>", "template": "string",
}
#: Event paths that a parser can fill from the record.
PATHS = (
    "device.hostname actor.process.name actor.process.pid actor.process.cmd_line actor.process.parent_process.name actor.process.parent_process.cmd_line actor.process.file.path "
    "actor.user.name actor.user.uid actor.user.domain src_endpoint.ip src_endpoint.port src_endpoint.hostname dst_endpoint.ip dst_endpoint.port dst_endpoint.hostname "
    "connection_info.protocol_name connection_info.direction auth_protocol status message metadata.log_provider metadata.log_name metadata.event_code metadata.uid_alt "
    "http_request.http_method http_request.url.path http_response.code finding.title"
).split()
#: Fields that time and severity are read from, and the record's message.
FIELDS = "datetime date time month day timestamp level text".split()
#: Fields of a record that stand for these, in order.
ALIASES = {"datetime": ("datetime", "date_time"), "date": ("date",), "time": ("time",), "month": ("month",), "day": ("day",), "timestamp": ("timestamp", "time_iso"), "level": ("level", "severity", "messageType", "message_type", "status"), "text": ("message",)}


@dataclass
class Parsed:
    """A family's attributes (see ATTRIBUTES) and values (by path or field name), as expressions over its helper columns."""

    given: dict[str, Sql | str | int | float]
    values: dict[str, Sql] = field(default_factory=dict)

    def attribute(self, name: str) -> Sql:
        value = self.given.get(name)
        return (value if isinstance(value, Sql) else F.lit(value)).cast(ATTRIBUTES[name])

    def value(self, name: str) -> Sql:
        return self.values[name] if name in self.values else F.lit(None).cast("string")


def by_family(parsers: dict[int, Parsed], family: Sql, read: Callable[[Parsed], Sql | None]) -> Sql | None:
    """What read() gives for the record's family; families for which it is a null literal are left out."""
    out = None
    for number, p in parsers.items():
        if (value := read(p)) is not None:
            out = F.when(family == number, value) if out is None else out.when(family == number, value)
    return out


def rows(keys: Sql, values: Sql) -> Sql:
    """Array of (k, v) of two arrays."""
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))).cast(PAIRS)
