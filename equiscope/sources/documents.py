"""JSON documents in columns: read by a schema, malformed ones marked and counted, and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "_malformed_text"


def parse_documents(df: DataFrame, column: str, schema: T.StructType | str, out: str = "document", malformed: str = "malformed") -> DataFrame:
    """``df`` with ``out`` (a struct of ``schema``) and the flag ``malformed``; columns of these names give way.

    NULL, empty and blank texts have neither a document nor the flag. A text
    that is no JSON, or holds a value that its field's type can't take, is
    flagged and has no document. Fields that a document lacks are NULL, fields
    beyond the schema are left out; of repeated fields the last counts. A
    schema may nest structs, arrays and maps.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.when(F.trim(F.col(column).cast("string")) != "", F.col(column).cast("string"))
    parsed = F.from_json(text, T.StructType([*fields.fields, T.StructField(_TEXT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TEXT})
    bad = F.coalesce(parsed[_TEXT].isNotNull(), F.lit(False))
    whole = F.struct(*[parsed[f.name].alias(f.name) for f in fields.fields])
    return df.withColumns({out: F.when(text.isNotNull() & ~bad, whole), malformed: bad})


def format_document(column: str, nulls: bool = True):
    """The JSON text of a struct, array or map column; NULL for NULL. ``nulls``: NULL fields are written, not left out."""
    return F.to_json(F.col(column), {"ignoreNullFields": "false" if nulls else "true"})
