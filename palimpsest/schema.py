"""Types and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
METADATA = T.StructType([T.StructField("source_url", T.StringType()), T.StructField("platform", T.StringType()), T.StructField("timestamp", T.LongType())])
RECORD = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("topic", T.StringType()), T.StructField("metadata", METADATA), T.StructField("imageBase64", T.StringType())])
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("file_path", T.StringType()),
    ]
)
CURSOR = T.StructType([T.StructField("topic", T.StringType()), T.StructField("cursor_ms", T.LongType())])

# Defaults and limits that results depend on.
DEFAULT_TOPIC, DEFAULT_PLATFORM, DEFAULT_ROLE = "Generale", "unknown", "unknown"
CHUNK_SIZE, CHUNK_OVERLAP, OVERLAP_LINES = 800, 80, 5
MAX_FILE_LENGTH = 200_000
SEARCH_K, MAX_DISTANCE = 4, 0.75
PAGE_SIZE, MAX_PAGE_SIZE = 50, 500
JOB_TTL_MS = 600_000

# Which files of a source tree count.
EXTENSIONS = "js ts jsx tsx mjs cjs php py java cs go rb rs cpp c h hpp vue svelte html css scss sass less sql sh bash yaml yml json toml md txt".split()
SKIPPED_NAMES = "node_modules .git dist build vendor .next __pycache__ .venv venv coverage .cache .idea .vscode target out".split()
SKIPPED_SUFFIXES = [r"package-lock\.json$", r"yarn\.lock$", r"pnpm-lock\.yaml$", r"composer\.lock$", r"\.min\.(js|css)$", r"\.bundle\.js$", r"\.chunk\.js$"]

# Hosts of the supported chat platforms, the first that a host contains counts.
PLATFORMS = [("chat.openai.com", "ChatGPT"), ("chatgpt.com", "ChatGPT"), ("gemini.google.com", "Gemini"), ("claude.ai", "Claude"), ("chat.deepseek.com", "DeepSeek")]
