"""Row types shared by the operators."""

STEP = "struct<file:string,line_number:int,line_content:string,variable:string,action:string>"
TRACE = (
    "struct<source_variable:string,source_file:string,source_line:int,sink_type:string,sink_file:string,"
    f"sink_line:int,sink_content:string,steps:array<{STEP}>>"
)
TRACES = f"array<{TRACE}>"
# A variable's way through its file; ``depth`` counts the steps before a call, ``own`` is that of the call on a source's line, or -1.
SINK = "struct<sink_type:string,sink_line:int,sink_content:string,depth:int>"
FLOW = f"struct<variable:string,sources:array<struct<ord:int,line:int,own:int>>,steps:array<{STEP}>,sinks:array<{SINK}>>"
FLOWS = f"array<{FLOW}>"
# Which flows (by position) start at a line or pass there, and how many of their traces do.
TOUCHES = "array<struct<line:int,flow:int,n:int>>"

# Columns of a finding.  rule_ord and match_ord keep the order of detection.
FINDING = [
    "file", "line_number", "line_content", "secret_type", "matched_value", "score", "severity", "category",
    "source", "entropy", "context_match", "structural_valid", "confidence", "taint_count", "taint_traces", "rule_ord", "match_ord",
]
