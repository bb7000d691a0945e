"""Names of the archive's tables, and schemas of what the engine writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The archive export's tables.
ORIGIN, ORIGIN_VISIT, SNAPSHOT, SNAPSHOT_BRANCH, SNAPSHOT_BRANCHES = "origin", "origin_visit", "snapshot", "snapshot_branch", "snapshot_branches"
REVISION, DIRECTORY, CONTENT, SKIPPED_CONTENT = "revision", "directory", "content", "skipped_content"
ENTRY_FILE, ENTRY_DIR, ENTRY_REV = "directory_entry_file", "directory_entry_dir", "directory_entry_rev"

LOADED = (ORIGIN, SNAPSHOT_BRANCH, REVISION, DIRECTORY, ENTRY_FILE, ENTRY_DIR, ENTRY_REV, CONTENT, SKIPPED_CONTENT)
ON_DEMAND = (SNAPSHOT_BRANCHES, SNAPSHOT, ORIGIN_VISIT)

REFS = (b"refs/heads/main", b"refs/heads/master")

STATUSES = ("success", "skipped_already_exists", "not_found", "rate_limited", "timeout", "network_error", "max_retries_exceeded", "unknown_error")

FILE_METADATA = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("sha1_git", T.BinaryType()), T.StructField("repo_url", T.StringType())])
DOWNLOAD_STATS = T.StructType([T.StructField("sha1_git", T.StringType()), T.StructField("local_path", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType())])
CONTENTS = T.StructType([T.StructField("sha1_git", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType()), T.StructField("content", T.BinaryType())])
