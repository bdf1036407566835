"""Package urls, CPE names, repository addresses and path globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def purl_key(purl: Column) -> Column:
    """``type/namespace/name`` in lower case, without version (after the last ``@``), qualifiers or subpath; Python names normalised."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(purl), r"[?#].*$", ""), r"@[^@/]*$", "")
    body = F.lower(F.try_url_decode(F.regexp_replace(bare, r"^pkg:/*", "")))
    return F.when(purl.startswith("pkg:") & (F.instr(body, F.lit("/")) > 1), F.when(body.startswith("pypi/"), F.concat(F.lit("pypi/"), F.regexp_replace(F.substr(body, F.lit(6)), r"[-_.]+", "-"))).otherwise(body))


def cpe_parts(cpe: Column) -> Column:
    """Fields of a CPE 2.3 name; an escaped colon does not split."""
    return F.split(cpe, r"(?<!\\):")


def cpe_key(cpe: Column) -> Column:
    """``vendor:product`` in lower case, null for other names."""
    p = cpe_parts(cpe)
    return F.when(cpe.startswith("cpe:2.3:") & (F.size(p) >= 5), F.lower(F.concat_ws(":", F.try_element_at(p, F.lit(4)), F.try_element_at(p, F.lit(5)))))


# Fixed: hosts whose first two path segments name a package.
HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}


def repository_purl(url: Column) -> Column:
    """``pkg:<host type>/<owner>/<name>``, or ``pkg:generic/<host>/<path>`` elsewhere; null without a path."""
    rest = F.regexp_replace(F.trim(url), r"^[a-z+]+://(?:[^@/]*@)?|^git@", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/:?#]+)", 1), r"^www\.", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/:?#]+(?::\d+)?[/:]([^?#]*)", 1), r"/+$", ""), r"\.git$", "")
    parts = F.split(path, "/")
    kind = F.lit(None).cast("string")
    for h, k in HOSTS.items():
        kind = F.when(host == h, k).otherwise(kind)
    known = F.when(kind.isNotNull() & (F.size(parts) >= 2), F.lower(F.concat(F.lit("pkg:"), kind, F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"))))
    return F.when((path == "") | (host == ""), F.lit(None).cast("string")).otherwise(F.coalesce(known, F.concat(F.lit("pkg:generic/"), host, F.lit("/"), path)))


def spliced(purl: Column, version: Column) -> Column:
    """The purl with its version, unless that is null or a span."""
    head, tail = F.regexp_extract(purl, r"^([^?#]*)", 1), F.regexp_extract(purl, r"^[^?#]*(.*)$", 1)
    return F.when(version.isNull() | F.contains(version, F.lit("~")), purl).otherwise(F.concat(F.regexp_replace(head, r"@[^@/]*$", ""), F.lit("@"), version, tail))


def glob_regex(glob: str, suffix: bool = False) -> str:
    """An anchored regular expression: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside one name, ``[...]`` a set."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end + 1
        else:
            out.append("\\" + glob[i] if not glob[i].isalnum() else glob[i])
            i += 1
    return ("(?:^|/)" if suffix else "^") + "".join(out) + "$"
