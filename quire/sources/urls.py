"""Repository URLs: an allowlist parser in native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "github.com"


def explicit_port(url: Column) -> Column:
    """Whether the authority ends in a port, even the default one."""
    authority = F.substring_index(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), "@", -1)
    return authority.rlike(":[0-9]+\\z")


def valid_repo_segment(segment: Column) -> Column:
    return segment.rlike("^[A-Za-z0-9_.-]+\\z") & ~segment.isin(".", "..")


def valid_ref(ref: Column) -> Column:
    return ref.rlike("^[A-Za-z0-9._/-]+\\z") & ~ref.startswith("-") & ~F.contains(ref, F.lit(".."))


def valid_subpath(subpath: Column) -> Column:
    return F.forall(F.split(subpath, "/", -1), lambda s: s.rlike("^[A-Za-z0-9._-]+\\z") & ~s.startswith("-") & ~s.isin(".", ".."))


def parse_repository_url(raw: Column) -> Column:
    """struct<url, ref, subpath>, null where the input isn't one of the allowed forms.

    Forms: https://host/org/repo, .../tree/ref[/subpath] and .../blob/ref/path; no port, credentials,
    query or fragment. Dot segments are resolved as in browsers only as far as rejecting them."""
    pattern = "^(?i:https)://([^/?#@:]+)(/[^?#]*)\\z"
    host, path = F.lower(F.regexp_extract(raw, pattern, 1)), F.regexp_extract(raw, pattern, 2)
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    org, repo, form, ref = (F.get(parts, F.lit(i)) for i in range(4))
    rest = F.array_join(F.slice(parts, 5, 1 << 30), "/")
    name = F.regexp_replace(repo, "(?i)\\.git\\z", "")
    n = F.size(parts)
    base = (host == HOST) & ~explicit_port(raw) & (n >= 2) & valid_repo_segment(org) & valid_repo_segment(repo) & (name != "")
    tree = (form == "tree") & (n >= 4) & valid_ref(ref) & ((n == 4) | valid_subpath(rest))
    blob = (form == "blob") & (n >= 5) & valid_ref(ref) & valid_subpath(rest)
    ok = base & ((n == 2) | tree | blob)
    url = F.concat(F.lit(f"https://{HOST}/"), org, F.lit("/"), name, F.lit(".git"))
    return F.when(ok, F.struct(url.alias("url"), F.when(n > 2, ref).alias("ref"), F.when(n > 4, rest).alias("subpath")))
