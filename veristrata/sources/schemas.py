"""Explicit schemas (DDL) of the records that sources read."""

CORPUS = "doc_id BIGINT, title STRING, abstract ARRAY<STRING>, structured BOOLEAN"
NATIVE_CLAIM = "id BIGINT, claim STRING, cited_doc_ids ARRAY<BIGINT>, evidence MAP<STRING,ARRAY<STRUCT<label:STRING,sentences:ARRAY<INT>>>>"
MANIFEST = "manifest_id STRING, role STRING, source_file STRING, source_sha256 STRING, n_ids INT, ids_sha256 STRING, ids ARRAY<BIGINT>, locked BOOLEAN"
SAMPLE = (
    "sample_id STRING, split_role STRING, seed INT, n_ids INT, ids_sha256 STRING, claim_ids ARRAY<STRING>, native_ids ARRAY<BIGINT>, "
    "source_manifest STRING, label_distribution MAP<STRING,INT>"
)
PREDICTION = (
    "claim_id STRING, label STRING, label_pred STRING, predicted_label STRING, label_gold STRING, gold_label STRING, gold STRING, adaptation STRING, "
    "method_id STRING, inference_mode STRING, execution_status STRING, confidence DOUBLE, label_4way STRING, d0_label_4way STRING, d1_label_4way STRING, "
    "rationale_codes ARRAY<STRING>, question_family STRING, claim_family STRING"
)
SIDECAR = (
    "run_id STRING, split STRING, seed INT, corpus_hash STRING, config_hash STRING, timestamps STRUCT<started_at:STRING,finished_at:STRING,latency_seconds:DOUBLE>, "
    "tokens STRUCT<n_calls:BIGINT,prompt_tokens:BIGINT,completion_tokens:BIGINT,total_tokens:BIGINT,latency_seconds:DOUBLE>, status STRING"
)
HIT = "STRUCT<doc_id:BIGINT,rank:INT,score:DOUBLE>"
BUNDLE = f"claim_id STRING, query STRING, queries ARRAY<STRUCT<form:STRING,query:STRING,hits:ARRAY<{HIT}>>>, retrieval_round INT, corpus_hash STRING, passages ARRAY<{HIT}>"
RUN = "run STRUCT<run_id:STRING,split:STRING,corpus_hash:STRING>, run_id STRING"
