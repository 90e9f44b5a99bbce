"""Declared schemas of the symbol graph's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(*fields: tuple) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "strings": _TEXTS}
    return T.StructType([T.StructField(name, kinds.get(kind, kind), null) for name, kind, null in fields])


CALL_SITES = T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("receiver", T.StringType())]))

#: One row for each symbol of scanned sources, in pre-order.
SYMBOLS = _struct(
    ("module", "string", False), ("file_path", "string", False), ("language", "string", False), ("package_name", "string", True), ("file_ord", "int", False), ("sym_ord", "int", False),
    ("parent_ord", "int", True), ("name", "string", False), ("kind", "string", False), ("visibility", "string", False), ("signature", "string", True), ("doc_comment", "string", True),
    ("extends_name", "string", True), ("gql_operation_type", "string", True), ("api_method", "string", True), ("api_path", "string", True), ("annotations", "strings", True),
    ("implements_names", "strings", True), ("jsx_elements", "strings", True), ("gql_fields", "strings", True), ("call_sites", CALL_SITES, True), ("start_line", "int", False), ("end_line", "int", False),
)
FILES = _struct(("file_id", "long", False), ("path", "string", False), ("hash", "string", False), ("language", "string", False), ("module", "string", True), ("scanned_at", "long", False))
EDGES = _struct(("source_id", "long", False), ("target_id", "long", False), ("kind", "string", False), ("metadata", "string", True), ("edge_seq", "long", False))

EDGE_KINDS = ("imports", "extends", "implements", "calls", "renders", "gql_resolves", "type_match", "rest_match", "injects")
SCHEMA_VERSION = 1
