"""Fixed schemas of the code index; never inferred."""

SYMBOLS = "id string, file string, name string, qualified_name string, kind string, language string, signature string, docstring string, summary string, decorators array<string>, keywords array<string>, parent string, line int, end_line int, byte_offset int, byte_length int, content_hash string, cyclomatic int, max_nesting int, param_count int, call_references array<string>"
FILES = "path string, hash string, mtime_ns long, language string, size_bytes long"
IMPORTS = "file string, specifier string, names array<string>, pos int"
CALLS = "file string, caller_id string, name string, line int"
MATCHES = "file string, rule string, severity string, line int, end_line int, snippet string"
COMMITS = "sha string, author string, ts timestamp, subject string, file string"
EMBEDDINGS = "id string, model string, vec array<float>"
