"""Declared schemas of the tables which enter and leave as files."""

from __future__ import annotations

_PAIRS = "array<struct<name:string,count:bigint>>"

CLUSTERS = (
    "cluster_id string, family string, size bigint, "
    f"top_capability_names {_PAIRS}, top_operation_terms {_PAIRS}, "
    f"top_agentic_dimensions {_PAIRS}, top_domains {_PAIRS}, "
    f"top_target_model_types {_PAIRS}, top_benchmarks {_PAIRS}, top_tasks {_PAIRS}"
)
MENTIONS = (
    "pos bigint, cluster_id string, paper_title string, benchmark_name string, "
    "task_name string, canonical_name string, definition string, cognitive_operation string, "
    "surface_task string, evaluated_behavior string, agentic_dimensions array<string>, "
    "domain_metadata array<string>, confidence string"
)
JUDGE_RESULTS = (
    "pos bigint, cluster_id string, family string, size bigint, status string, "
    "elapsed_sec double, model string, thinking boolean, response_text string, "
    "reasoning_content string, usage string, error string"
)
SELECTION = (
    "pos bigint, cluster_id string, cluster_name string, excluded boolean, "
    "top_scorer_benchmarks array<struct<name:string,n:bigint>>"
)
FINAL_MENTIONS = "pos bigint, final_cluster_id string, benchmark_name string, paper_title string"
CANDIDATES = (
    "benchmark string, query_no int, pos int, id string, downloads bigint, likes bigint, desc string"
)
SPLITS = "dataset_id string, pos bigint, config string, split string"
EXPERIMENT_CLUSTERS = (
    "cluster_id string, cluster_name string, "
    "datasets array<struct<hf_dataset:string,status:string,file:string>>"
)
DATASET_ROWS = "dataset_id string, row_idx bigint, row_json string"
PROBE_TEXTS = "uid string, dataset_id string, clusters array<string>, text string"
HIDDEN = "tag string, layer int, uid string, h array<float>"
METHOD_RESULTS = (
    "tag string, layer int, cluster_id string, n_datasets int, diffmean double, pca double, lr double"
)
VERBALIZERS = "name string, words array<string>"
VOCABULARY = "token_id int, text string, is_special boolean"
