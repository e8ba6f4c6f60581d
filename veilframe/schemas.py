"""Explicit schemas (DDL) of the document collections; nothing is inferred at read time."""

from __future__ import annotations

TAGS = (
    "NAME", "IDENTIFICATION_NUMBER", "DRIVER_LICENSE_NUMBER", "PHONE_NUMBER", "PASSPORT_NUMBER", "EMAIL_ADDRESS", "SEX", "AGE",
    "LOCATION", "NATIONALITY", "EDUCATION", "RELATIONSHIP", "OCCUPATION", "AFFILIATION", "POSITION",
)
CODE_TAGS = TAGS[1:6]
ENTITY_TYPES = ("PERSON", "CODE", "LOC", "ORG", "DEM", "DATETIME", "QUANTITY", "MISC")
#: Tags that a document in error is filled with: the fifteen and one more.
FILLER_TAGS = (*TAGS, "RELIGION")


PII = "struct<tag:string,keyword:string,certainty:int,hardness:int>"
SUBJECT = f"struct<id:string,description:string,PIIs:array<{PII}>>"
ENTITY = "struct<span_text:string,entity_type:string,start_offset:int,end_offset:int,span_id:string,entity_id:string,annotator:string,identifier_type:string>"
ALIGNED = f"struct<id:int,matched:boolean,unmatched_side:string,description:string,PIIs:struct<annotation_A:array<{PII}>,annotation_B:array<{PII}>>>"
EVALUATION = "struct<keyword_A:string,keyword_B:string,certainty_A:int,certainty_B:int,hardness_A:int,hardness_B:int,agreement_score:double,evaluation_method:string,match:boolean,less_precise:boolean,mismatch:boolean>"

ANNOTATED = f"metadata struct<data_id:string,number_of_subjects:int>, text string, anonymized_text string, subjects array<{SUBJECT}>"
ENTITY_DOC = f"metadata struct<data_id:string>, text string, anonymized_text string, entities array<{ENTITY}>"
ANONYMIZED = f"metadata struct<data_id:string,number_of_subjects:int>, text string, anonymized_text string, length_diff int, length_ratio double, length_anomaly boolean, entities array<{ENTITY}>"
COMBINED = f"metadata struct<data_id:string,number_of_subjects:int,gt_file:string,llm_file:string>, text string, anonymized_text string, annotation_A array<{SUBJECT}>, annotation_B array<{SUBJECT}>"
ALIGNED_DOC = f"metadata struct<data_id:string,number_of_subjects:int,cross_labeled:boolean>, status string, text string, anonymized_text string, subjects array<{ALIGNED}>"
REPORT = f"config map<string,string>, detailed_results array<struct<data_id:string,number_of_subjects:int,subjects:array<struct<subject_id:int,description:string,evaluations:map<string,{EVALUATION}>>>>>"
RESPONSE_LOG = "data_id string, status string, response string, sa_response string, spc_response string, spnc_response string, number_of_subjects int"
ERROR_LOG = "data_id string, error_type string, error string, timestamp string"
TRAINING_DOC = "doc_id string, dataset_type string, text string, annotations map<string,struct<entity_mentions:array<struct<identifier_type:string,span_text:string,start_offset:int,end_offset:int>>>>"
