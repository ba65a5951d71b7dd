"""Tables of the code and lineage graphs. Edges are unique by (graph, src, dst), nodes by (graph, id)."""

LINE_RANGE = "struct<start int, end int>"
EVIDENCE = f"struct<source_file string, line_range {LINE_RANGE}, analysis_method string, node string, module string, transformation_type string>"

FILES = "path string, ext string, language string, text string, size long, mtime timestamp"
NODES = f"graph string, id string, node_type string, name string, source_file string, line_range {LINE_RANGE}, transformation_type string, storage_type string, unresolved boolean, seq long"
EDGES = f"graph string, src string, dst string, edge_type string, weight double, source_file string, line_range {LINE_RANGE}, analysis_method string, transformation_type string, unresolved boolean, seq long"
COMMITS = "hash string, committed_at string, path string"
MODULES = "path string, language string, loc int, comment_ratio double, complexity double, imports array<string>, public_functions array<string>, classes array<string>, class_inheritance map<string, array<string>>, last_modified string"

NODE_TYPES = ("module", "dataset", "function", "transformation", "config", "pipeline")
EDGE_TYPES = ("IMPORTS", "PRODUCES", "CONSUMES", "CALLS", "CONFIGURES")
