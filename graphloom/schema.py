"""Schemas of the engine's tables and the code maps of its enums."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum codes of the interchange format.
TOKEN_TYPES = ("WS", "Keyword", "Identifier", "Punctuation", "Comment", "Literal")
NODE_KINDS = ("Definition", "Directory", "File", "Structure", "SourceFile", "Class")
#: Names that JSON uses for node kinds.
NODE_KIND_JSON = {"Definition": "definition", "Directory": "directory", "File": "sourcefile", "Structure": "structure", "SourceFile": "fullsourcefile", "Class": "class"}
ITEM_KINDS = ("Symbol", "Directory", "File", "Macro")

LOCATION = T.StructType().add("line", "integer").add("column", "integer").add("offset", "long")
HREF = T.StructType().add("kind", "string").add("node_id", "long").add("sym_id", "long").add("path", "string").add("offset", "long").add("blob_id", "long").add("end", "long")
TOKEN = (
    T.StructType()
    .add("offset", "long")
    .add("type", "string")
    .add("href", HREF)
    .add("has_references", "boolean")
    .add("sym_id", "long")
    .add("real_offset", "long")
    .add("real_line", "integer")
    .add("uim_location", LOCATION)
    .add("uim_elided", "boolean")
)
NODE = (
    T.StructType()
    .add("id", "long")
    .add("kind", "string")
    .add("path", "string")
    .add("container", "long")
    .add("start", LOCATION)
    .add("text", "string")
    .add("tokens", T.ArrayType(TOKEN))
    .add("member_of", "string")
    .add("path_id", "integer")
    .add("uim_reference_context", "string")
    .add("uim_nest_level", "integer")
)
INDEX_ITEM = T.StructType().add("key", "string").add("href", HREF).add("kind", "string").add("path", "string").add("type", "string")
#: Declared by the model; no operator makes or reads it.
IMPLEMENTATIONS = T.StructType().add("node_id", "long").add("offset", "long").add("impls", T.ArrayType(T.StructType().add("href_node_id", "long").add("href_offset", "long").add("name", "string")))
BUILD = T.StructType().add("build_id", "string").add("repo_id", "string").add("branch", "string").add("nodemap", "string").add("symmap", "string").add("refmap", "string").add("repo_root_node_id", "long").add("ended", "timestamp")
