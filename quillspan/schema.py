"""Row schemas of the text operators, as Spark DDL."""

SPAN = "ordinal int, kind string, text string, start_byte int, end_byte int, start_rune int, end_rune int, start_line int, start_column int, end_line int, end_column int, atomic boolean, heading_level int, heading_path array<string>, language string, level string"
DIAGNOSTIC = "struct<code:string,severity:string,message:string,start_byte:int,end_byte:int>"
CHUNK = f"ordinal int, text string, start_byte int, end_byte int, start_rune int, end_rune int, span_ordinals array<int>, heading_path array<string>, weight int, oversized boolean, level string, diagnostics array<{DIAGNOSTIC}>"
NODE = "node_id int, parent_id int, depth int, child_index int, path array<int>, type string, text string, level int, language string, destination string, title string, alt string, ordered boolean, start int, marker string, info string, raw string, start_byte int, end_byte int, start_rune int, end_rune int, start_line int, start_column int, end_line int, end_column int, text_content string"
CANDIDATE = "kind string, format string, text string, raw string, wrapper string, label string, info string, start_byte int, end_byte int, start_row int, start_column int, end_row int, end_column int, payload_start_byte int, payload_end_byte int, payload_start_row int, payload_start_column int, payload_end_row int, payload_end_column int, confidence double, diagnostics array<string>"
FIX = "struct<rule:string,description:string,before:string,after:string>"
ISSUE = "struct<rule:string,source:string,description:string,start_byte:int,end_byte:int,start_row:int,start_col:int,end_row:int,end_col:int,row:int>"
VALIDATION = f"valid boolean, format string, sanitized string, errors array<string>, fixes array<{FIX}>, issues array<{ISSUE}>"
SANITIZED = f"original string, sanitized string, errors array<string>, lint_issues array<{ISSUE}>, fixes array<{FIX}>, parse_clean boolean, lint_clean boolean, strict_parse_clean boolean, original_strict_parse_clean boolean"
BLOCK = "name string, kind string, text string, raw string, start_byte int, end_byte int, json_value string"
DOCUMENT = f"has_frontmatter boolean, frontmatter string, body string, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, error string"
RENDERED = "text string, template_name string, mode string, bytes int, error string"
