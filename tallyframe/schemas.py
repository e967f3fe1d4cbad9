"""Schemas of the stored records."""


BOX = "array<bigint>"
CITATION = f"struct<image_id:string,bbox:{BOX},time:string>"
LINK = f"struct<relation:string,left:{CITATION},right:{CITATION},min_iou:double>"
# One nullable union: a legacy image id, a region (bbox set) or a relation (relation set).
REQ = f"struct<image_id:string,bbox:{BOX},time:string,relation:string,left:{CITATION},right:{CITATION},min_iou:double>"
SETS = f"map<string,array<array<{REQ}>>>"
SUBCLAIM = f"struct<id:string,kind:string,truth:string,minimal_evidence_sets:{SETS}>"
ANNOTATION = f"struct<protocol:string,status:string,verdict:string,subclaims:array<{SUBCLAIM}>,minimal_evidence_sets:{SETS}>"
EVIDENCE = (
    "struct<id:string,source_id:string,object:string,time:string,view:string,available:boolean,"
    f"source_size:array<bigint>,source_bbox:{BOX},camera_view:string>"
)
DECISION = f"struct<verdict:string,citations:array<{CITATION}>,links:array<{LINK}>>"
PART = "struct<type:string,text:string,image_ref:string>"
CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,name:string,tool_call_id:string,content:array<{PART}>,tool_calls:array<{CALL}>>"
GENERATION = "struct<input_tokens:bigint,output_tokens:bigint,latency_s:double,halt:string,reasoning_tokens:bigint>"

CASE_DDL = (
    "case_id string, family_id string, variant string, task string, category string, claim string, "
    f"initial array<string>, evidence array<{EVIDENCE}>, "
    "request_options struct<objects:array<string>,times:array<string>,views:array<string>>, "
    f"group_ids array<string>, provenance_truth string, annotation {ANNOTATION}, official_split string"
)
RESULT_DDL = (
    "case_id string, family_id string, variant string, task string, model string, arm string, verdict string, "
    "source_label string, termination string, requests bigint, tool_calls bigint, errors bigint, "
    "input_tokens bigint, output_tokens bigint, latency_s double"
)
TRACE_DDL = f"case_id string, arm string, messages array<{MESSAGE}>, generation array<{GENERATION}>, wall_latency_s double"
SOURCE_DDL = "object string, split string, label string, image string, mask string"
FRAME_DDL = (
    "sequence_name string, frame_number bigint, image struct<path:string,size:array<bigint>>, "
    "mask struct<path:string>, viewpoint struct<R:array<array<double>>,T:array<double>>"
)
