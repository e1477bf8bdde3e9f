"""Deciding how a scan target's address is to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text

_SCHEME = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*):"
_REST = r"(?s)\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(.*)\z"
_AUTHORITY = r"(?s)\A//([^/?#]*)"
_PATH = r"(?s)\A(?://[^/?#]*)?([^?#]*)"
# Parameters after ";" in the last path part belong to the address, not the name.
_PARAMETERS = r";[^/]*\z"
_WITH_PARAMETERS = ["", "ftp", "http", "https", "rtsp", "sip", "sips", "mms", "sftp", "tel"]


def _address(url: Column) -> tuple[Column, Column, Column]:
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    rest = F.regexp_extract(url, _REST, 1)
    path = F.regexp_extract(rest, _PATH, 1)
    path = F.when(scheme.isin(_WITH_PARAMETERS), F.regexp_replace(path, _PARAMETERS, "")).otherwise(path)
    return scheme, F.regexp_extract(rest, _AUTHORITY, 1), path


def classify_targets(targets: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``source_kind`` (git, zip or file) and ``file_name`` to addresses."""
    scheme, authority, path = _address(F.col(url))
    is_git = (
        F.col(url).startswith("git@")
        | (scheme.isin("http", "https", "ssh") & path.endswith(".git"))
        | (scheme.isin("http", "https") & authority.contains("github.com"))
    )
    base = text.file_name(path)
    name = F.when(base == "", fv.DEFAULT_DOWNLOAD_NAME).otherwise(base)
    kind = F.when(is_git, "git").when(text.suffix(name) == ".zip", "zip").otherwise("file")
    return targets.withColumn("source_kind", kind).withColumn("file_name", F.when(~is_git, name))
