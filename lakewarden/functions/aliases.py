"""The field names, labels and metadata names by which records are understood.

Order is precedence: the first alias that a record has wins.
"""

ANSWER = ("answer", "expected", "expected_answer", "gold", "gold_answer", "label", "reference", "reference_answer")
INPUT = ("prompt", "question", "input")
RAG_CONTENT = ("text", "content", "document", "body", "chunk", "page_content")
SAMPLE_ID = ("id", "sample_id", "example_id", "record_id", "case_id")
CONTEXT_ID = ("doc_id", "document_id", "context_id", "source_id", "chunk_id")
RAG_ID = ("id", *CONTEXT_ID)
CONTEXT_ID_LIST = ("doc_ids", "document_ids", "context_ids", "source_ids", "chunk_ids", "retrieved_context_ids")
CONTEXT = ("context", "contexts", "documents", "docs", "retrieved_context", "retrieval_context", "sources", "chunks")
ROW_COLLECTION = ("examples", "samples", "records", "rows", "data", "items")
METRICS = ("accuracy", "accuracy_percent", "exact_match", "f1", "precision", "recall", "bleu", "rouge", "loss", "perplexity", "pass_rate", "success_rate", "win_rate")
METADATA = {
    "model_id": ("model", "model_id", "model_name"),
    "generation_parameters": ("generation_parameters", "generation_params", "parameters", "params"),
    "prompt_fingerprint": ("prompt_fingerprint", "prompt_hash", "prompt_sha256"),
    "prompt_version": ("prompt_version", "prompt_id"),
    "dataset_fingerprint": ("dataset_fingerprint", "dataset_hash", "dataset_sha256"),
    "dataset_version": ("dataset_version", "dataset_id"),
    "metric_name": ("metric", "metric_name"),
    "metric_definition": ("metric_definition", "metric_description"),
    "metric_threshold": ("threshold", "pass_threshold", "metric_threshold"),
    "timestamp": ("timestamp", "created_at", "evaluated_at"),
}
METADATA_SECTIONS = ("metadata", "eval", "evaluation", "run")
TRIVIAL_ANSWERS = ("yes", "no", "true", "false")
SHORTEST_ANSWER = 16

TRAINING = ("training_dataset",)
EVALUATION = ("evaluation_dataset", "benchmark_dataset")
DATASETS = ("training_dataset", "evaluation_dataset", "benchmark_dataset")
ROLES = ("training_dataset", "evaluation_dataset", "benchmark_dataset", "evaluation_result", "prompt_template", "rag_document", "configuration", "unknown")

INTERPOLATED_NAMES = ("context", "retrieved_context", "documents", "docs", "chunks", "sources", "retrieval_results")
DELIMITERS = ("```", "<context>", "</context>", "<documents>", "</documents>", "BEGIN CONTEXT", "END CONTEXT", "BEGIN DOCUMENTS", "END DOCUMENTS")

EVIDENCE_LIMIT = 20
