"""Path and URI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .lookups import nullif_empty


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_traversal(path: Column) -> Column:
    """A model's own reference leaves its directory: absolute, UNC, drive letter or a ``..`` segment."""
    return _slashes(path).rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def archive_traversal(path: Column) -> Column:
    """The archive variant has no drive-letter test."""
    return _slashes(path).rlike(r"^/|(^|/)\.\.(/|$)")


def unsafe_bundle_name(name: Column) -> Column:
    """Reason a bundle entry name is refused, or NULL."""
    return (
        F.when(name.isin("", "."), "empty name")
        .when(F.startswith(name, F.lit("/")), "absolute path")
        .when((name == "..") | F.startswith(name, F.lit("../")) | F.contains(name, F.lit("/../")), "traversal")
        .when(F.contains(name, F.lit("\\")), "backslash")
    )


def clean_segments(path: Column) -> Column:
    """Segments of a slash path with ``.`` dropped and ``..`` folded; leading ``..`` are kept."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def clean_path(path: Column) -> Column:
    """Cleaned absolute path: folding cannot climb above the root."""
    kept = F.filter(clean_segments(path), lambda s: s != "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def link_escape(root: Column, link_path: Column, target: Column) -> Column:
    """A link at ``root/link_path`` points outside ``root``. ``root`` is absolute."""
    folder = F.regexp_replace(link_path, r"[^/]*$", "")
    resolved = F.when(F.startswith(target, F.lit("/")), clean_path(target)).otherwise(
        clean_path(F.concat(root, F.lit("/"), folder, F.lit("/"), target))
    )
    return ~F.startswith(resolved, F.concat(clean_path(root), F.lit("/")))


def hub_url(name: Column, kind: str = "model") -> Column:
    base = "https://huggingface.co/" + ("datasets/" if kind == "dataset" else "")
    return F.when(name.rlike(r"^[^/ \\:]*/[^/ \\:]*$"), F.concat(F.lit(base), name))


def purl(url: Column, commit: Column) -> Column:
    """Package URL of a hub repository; NULL when the URL gives no basis for one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.btrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    owner, repo = F.split_part(path, F.lit("/"), F.lit(1)), F.split_part(path, F.lit("/"), F.lit(2))
    revision = F.coalesce(F.concat(F.lit("@"), F.lower(nullif_empty(commit))), F.lit(""))
    return F.when(
        host.isin(V.HUB_HOSTS) & (owner != "") & (repo != ""),
        F.concat(F.lit("pkg:huggingface/"), owner, F.lit("/"), repo, revision),
    )


def uri_scheme(uri: Column) -> Column:
    return F.lower(nullif_empty(F.regexp_extract(uri, r"^(.+?)://", 1)))


def hub_reference(uri: Column) -> Column:
    """Struct ``(repo, revision, error)`` of a hub URI."""
    text = F.regexp_replace(uri, r"^(?i:hf://)", "")
    text = F.regexp_replace(text, r"^(?i:huggingface://)", "")
    text = F.regexp_replace(text, r"^(?is:.*?huggingface\.co/)", "")
    text = F.btrim(text, F.lit("/"))
    # the two separators are tried in this order, and each only at its first occurrence
    tree = F.locate("/tree/", text)
    blob = F.locate("/blob/", text)
    position = F.when(tree > 0, tree).otherwise(blob)
    has_branch = position > 0
    head = F.when(has_branch, F.left(text, position - 1)).otherwise(text)
    branch = F.when(has_branch, F.btrim(F.substr(text, position + 6), F.lit("/"))).otherwise("")
    at = F.regexp_extract(head, r"^(.*)@([^@]*)$", 2)
    has_at = F.contains(head, F.lit("@"))
    repo = F.when(has_at, F.regexp_extract(head, r"^(.*)@([^@]*)$", 1)).otherwise(head)
    revision = F.when(has_at, at).otherwise(branch)
    parts = F.split(repo, "/")
    error = F.when(parts[0] == "", "no repository").when(F.size(parts) > 2, "too many segments")
    return F.struct(
        F.when(error.isNull(), repo).alias("repo"),
        F.when(error.isNull(), nullif_empty(revision)).alias("revision"),
        error.alias("error"),
    )


def mlflow_rewrite(uri: Column, tracking_url: Column) -> Column:
    """``mlflow-artifacts:`` location as a self-describing URI against the tracking host."""
    host = nullif_empty(F.regexp_extract(tracking_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(uri, r"^mlflow-artifacts:", ""), r"^//", "")
    slash = F.locate("/", rest)
    authority = F.contains(rest, F.lit(":")) & (slash > 1)
    rest = F.when(authority, F.substr(rest, slash)).otherwise(rest)
    return F.when(
        F.startswith(uri, F.lit("mlflow-artifacts:")),
        F.concat(F.lit("mlflow://"), host, F.lit("/"), F.regexp_replace(rest, r"^/", "")),
    )


def safe_join(base: str, rel: Column) -> Column:
    """Join that folds the relative path at the root first, so that it cannot leave ``base``."""
    joined = clean_path(_slashes(rel))
    return F.when(joined == "/", F.lit(base)).otherwise(F.concat(F.lit(base), joined))
