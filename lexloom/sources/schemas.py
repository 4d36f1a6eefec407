"""Schemas as Spark DDL; readers never infer."""

SLOTS = "ARRAY<STRUCT<type: STRING, value: STRING>>"
EXPECTED = f"STRUCT<intent: STRING, slots: {SLOTS}>"
PROVENANCE = (
    "STRUCT<recipe: STRING, model: STRING, model_digest: STRING, prompt_version: STRING, seed_sample_id: ARRAY<STRING>, "
    "gen_params: STRUCT<temperature: DOUBLE, top_p: DOUBLE, seed: BIGINT, context_length: INT>, "
    "filter_score: MAP<STRING, DOUBLE>, filter_stage_passed: STRING, reject_reason: STRING, generated_at: TIMESTAMP, pair_id: STRING>"
)
SAMPLE = f"STRUCT<id: STRING, utt: STRING, intent: STRING, slots: {SLOTS}, style: STRING, provenance: {PROVENANCE}>"
RECORD = (
    f"schema_version INT, generation_index BIGINT, plan_fingerprint STRING, expected {EXPECTED}, sample {SAMPLE}, raw_content STRING, "
    "generation_contract_reason STRING, validation_error STRING, metrics STRUCT<wall_seconds: DOUBLE, prompt_eval_count: BIGINT, eval_count: BIGINT>"
)
EXAMPLE = f"id STRING, utt STRING, intent STRING, slots {SLOTS}"
PREDICTION = "grp STRING, seed INT, generation_index BIGINT, expected STRUCT<id: STRING, utt: STRING, intent: STRING, slots: " + SLOTS + ">, raw_prediction STRING, wall_seconds DOUBLE, output_tokens INT"
VECTOR = "id STRING, role STRING, ord BIGINT, vec ARRAY<FLOAT>"
EXCLUSION = "sample_id STRING, similarity DOUBLE, matched_eval_id STRING, split STRING"
ANNOTATED = "id STRING, locale STRING, partition STRING, scenario INT, intent INT, utt STRING, annot_utt STRING"
