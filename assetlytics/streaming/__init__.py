from .file_scoring import UPLOAD_SCHEMA, run_to_completion, score_stream, score_uploads_stream  # noqa: F401
