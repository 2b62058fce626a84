"""Schemas of the stored tables; nothing is inferred."""

FILES = "file_path string, mtime_ms double, bytes long, language string, content string"
SPAN = "line int, end_line int"
SYMBOL = f"name string, kind string, {SPAN}, signature string, doc string, parent string, modifiers array<string>, extends array<string>, implements array<string>, value string, exported boolean"
IMPORT = "source string, kind string, imported string, local string, line int"
EXPORT = "source string, kind string, local string, exported string, line int"
CALL = "caller string, callee string, receiver string, n_args int, line int, kind string, chain_position int, chain_previous string, chain_next string"
COMMENT = f"kind string, text string, {SPAN}"
ERROR = "message string, line int"
PARSED = f"file_path string, language string, symbols array<struct<{SYMBOL}>>, imports array<struct<{IMPORT}>>, exports array<struct<{EXPORT}>>, calls array<struct<{CALL}>>, comments array<struct<{COMMENT}>>, errors array<struct<{ERROR}>>"
for _name in ("SYMBOL", "IMPORT", "EXPORT", "CALL", "COMMENT", "ERROR"):
    PARSED = PARSED.replace(globals()[_name], ", ".join(p.strip().replace(" ", ":", 1) for p in globals()[_name].split(", ")))
