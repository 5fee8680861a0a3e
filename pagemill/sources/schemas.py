"""Column types of the tables."""

PAGES = "page_id BIGINT, url STRING, html STRING"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

CRAWL_CONFIG = (
    "STRUCT<js_code: STRING, wait_for: STRING, css_selector: STRING, content_selector: STRING, screenshot: BOOLEAN, "
    "pdf: BOOLEAN, verbose: BOOLEAN, content_filter_threshold: DOUBLE, stage2_fallback_enabled: BOOLEAN>"
)

TASK_CONFIG = (
    f"name STRING, description STRING, urls ARRAY<STRING>, crawl_config {CRAWL_CONFIG}, llm_provider STRING, llm_model STRING, "
    "llm_params MAP<STRING, STRING>, prompt_template STRING, output_schema STRING, deduplication_enabled BOOLEAN, "
    "only_after_date STRING, fallback_download_enabled BOOLEAN, fallback_max_size_mb INT"
)

TASKS = "id STRING, " + TASK_CONFIG.replace("only_after_date STRING", "only_after_date TIMESTAMP_NTZ") + (
    ", created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
RUNS = (
    "id STRING, task_id STRING, status STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, "
    "urls_crawled INT, urls_failed INT, documents_created INT, minio_path STRING, manifest_path STRING, logs_path STRING, error_message STRING"
)
DOCUMENTS = (
    "id STRING, run_id STRING, source_url STRING, title STRING, content STRING, structured_data STRING, "
    "doc_metadata STRUCT<title: STRING, description: STRING, language: STRING, keywords: ARRAY<STRING>>, crawled_at TIMESTAMP_NTZ, "
    "markdown_path STRING, json_path STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
IMAGES = (
    "id STRING, document_id STRING, original_url STRING, minio_path STRING, alt_text STRING, size_bytes BIGINT, mime_type STRING, "
    "download_status STRING, download_method STRING, created_at TIMESTAMP_NTZ"
)
ATTACHMENTS = IMAGES.replace("alt_text", "filename")
REGISTRY = "id STRING, url STRING, task_id STRING, first_crawled_at TIMESTAMP_NTZ, last_crawled_at TIMESTAMP_NTZ, crawl_count BIGINT"

# What each listing shows.
VIEWS = {
    "task": (
        "id", "name", "description", "urls", "crawl_config", "llm_provider", "llm_model", "llm_params", "prompt_template", "output_schema",
        "deduplication_enabled", "only_after_date", "fallback_download_enabled", "fallback_max_size_mb", "created_at", "updated_at",
    ),
    "run": (
        "id", "task_id", "status", "started_at", "completed_at", "urls_crawled", "urls_failed", "documents_created", "minio_path",
        "manifest_path", "logs_path", "error_message", "created_at",
    ),
    "document": (
        "id", "run_id", "source_url", "title", "content", "structured_data", "doc_metadata", "crawled_at", "markdown_path", "json_path",
        "created_at", "updated_at",
    ),
    "image": (
        "id", "document_id", "original_url", "minio_path", "alt_text", "size_bytes", "mime_type", "download_status", "download_method",
        "created_at",
    ),
    "attachment": (
        "id", "document_id", "original_url", "minio_path", "filename", "size_bytes", "mime_type", "download_status", "download_method",
        "created_at",
    ),
}


def view(df, kind: str):
    """Columns of a listing, pruned at the scan."""
    return df.select(*VIEWS[kind])
