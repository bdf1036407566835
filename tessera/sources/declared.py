"""What a build selected or installed, read from package managers' own files into one table.

A range, a branch or a variable is no version and gives null.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.build import per_file

SCHEMA = "ecosystem string, name string, version string, purl string, url string"
_RANGE = re.compile(r"[\^~*<>=|, $]|\b[xX]\b")


def exact(v: str | None) -> str | None:
    v = (v or "").strip().strip("\"'")
    return v if v and not _RANGE.search(v) and re.search(r"\d", v) else None


def release_tag(v: str | None) -> str | None:
    """A tag that looks like a release, as its version."""
    m = re.fullmatch(r"(?:[A-Za-z][\w.]*?[-_])?[vVrR]?(\d+(?:[._]\d+)*(?:[-.]?(?:rc|alpha|beta|pre)\.?\d*)?[a-z]?)(?:[-_]RELEASE)?", v or "")
    return m[1].replace("_", ".") if m else None


def _row(ecosystem: str, name: str, version: str | None, kind: str | None = None, url: str | None = None) -> dict:
    purl = f"pkg:{kind}/{name}" + (f"@{version}" if version else "") if kind else None
    return {"ecosystem": ecosystem, "name": name, "version": version, "purl": purl, "url": url}


def cargo_lock(text: str) -> list[dict]:
    return [_row("cargo", p["name"], p.get("version"), "cargo") for p in tomllib.loads(text).get("package", []) if p["name"].endswith("-sys")]


def dpkg_status(text: str) -> list[dict]:
    out = []
    for block in re.split(r"\n\s*\n", text):
        f = dict(re.findall(r"(?m)^([\w-]+): (.*)$", block))
        if "Package" in f and "installed" in f.get("Status", "install ok installed").split():
            out.append(_row("dpkg", f["Package"], f.get("Version"), "deb/debian"))
    return out


def apk_installed(text: str) -> list[dict]:
    out = []
    for block in re.split(r"\n\s*\n", text):
        f = dict(re.findall(r"(?m)^([A-Za-z]):(.*)$", block))
        if "P" in f:
            out.append(_row("apk", f["P"], f.get("V"), "apk/alpine"))
    return out


def vcpkg_json(text: str) -> list[dict]:
    data = json.loads(text)
    fixed = {o["name"]: o.get("version") or o.get("version-string") or o.get("version-semver") for o in data.get("overrides", [])}
    out = []
    for d in data.get("dependencies", []):
        d = {"name": d} if isinstance(d, str) else d
        if not d.get("host"):
            out.append(_row("vcpkg", d["name"], fixed.get(d["name"])))
    return out


def meson_wrap(text: str) -> list[dict]:
    f = dict(re.findall(r"(?m)^\s*([\w_]+)\s*=\s*(.*?)\s*$", text))
    name = re.match(r"(.+?)[-_]v?(\d[\w.]*?)(?:$|\.tar|\.zip)", f.get("directory", "") or f.get("source_filename", ""))
    if name:
        return [_row("meson", name[1], name[2], url=f.get("source_url"))]
    return [_row("meson", f["url"].rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"), release_tag(f.get("revision")), url=f["url"])] if "url" in f else []


def cmake_lists(text: str) -> list[dict]:
    text = re.sub(r"(\"[^\"\n]*\")|#[^\n]*", lambda m: m[1] or "", text)  # comments, but not inside quotes
    out = []
    for m in re.finditer(r"(?i)\b(FetchContent_Declare|ExternalProject_Add|CPMAddPackage)\s*\(([^()]*)\)", text):
        words = re.findall(r'"[^"]*"|\S+', m[2])
        words = [w.strip('"') for w in words]
        if not words:
            continue
        if m[1].lower() == "cpmaddpackage" and (short := re.match(r"(?:gh|gl|bb):([\w.-]+)/([\w.-]+)[@#]v?(.+)", words[0])):
            out.append(_row("cmake", short[2], release_tag(short[3]) or exact(short[3]), url=f"https://github.com/{short[1]}/{short[2]}"))
            continue
        at = {w.upper(): words[i + 1] for i, w in enumerate(words[:-1]) if w.isupper()}
        name = at.get("NAME", words[0])
        tag = at.get("GIT_TAG") or at.get("VERSION")
        if not tag and "URL" in at and (u := re.search(r"[-_/]v?(\d+(?:\.\d+)+)", at["URL"])):
            tag = u[1]
        out.append(_row("cmake", name, release_tag(tag), url=at.get("GIT_REPOSITORY") or at.get("URL")))
    return out


def arduino_properties(text: str) -> list[dict]:
    f = dict(re.findall(r"(?m)^(\w+)=(.*)$", text))
    return [_row("arduino", f["name"].strip(), exact(f.get("version")))] if f.get("name") else []


def platformio_ini(text: str) -> list[dict]:
    out = []
    for block in re.findall(r"(?m)^lib_deps\s*=((?:.*)(?:\n[ \t]+.*)*)", text):
        for line in re.split(r"[\n,]", block):
            line = re.sub(r"\s[;#].*", "", line).strip()
            m = re.fullmatch(r"(?:([\w.-]+)/)?([^@/]+?)(?:\s*@\s*(.+))?", line)
            if line and m and not line.startswith(("http", "file", "symlink", "$")):
                out.append(_row("platformio", m[2].strip(), exact(m[3])))
    return out


def idf_lock(text: str) -> list[dict]:
    out, name = [], None
    for line in text.splitlines():
        if m := re.match(r"  (\S+):\s*$", line):
            name = m[1]
        elif name and (m := re.match(r"    version:\s*(\S+)", line)):
            out.append(_row("idf", name, exact(m[1])))
            name = None
    return out


def conan_lock(text: str) -> list[dict]:
    out = []
    for ref in json.loads(text).get("requires", []):
        m = re.match(r"([^/@#]+)/([^@#%]+)", ref if isinstance(ref, str) else "")
        if m:
            out.append(_row("conan", m[1], None if m[2].startswith("[") else exact(m[2]), "conan"))
    return out


def conan_txt(text: str) -> list[dict]:
    block = re.search(r"(?ms)^\[requires\]\s*\n(.*?)(?=^\[|\Z)", text)
    rows = [re.match(r"\s*([^/\s#]+)/([^@\s#]+)", x) for x in (block[1] if block else "").splitlines()]
    return [_row("conan", m[1], None if m[2].startswith("[") else exact(m[2]), "conan") for m in rows if m]


def bazel_module(text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"(?s)\bbazel_dep\s*\((.*?)\)", text):
        f = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', m[1]))
        if "name" in f and not re.search(r"dev_dependency\s*=\s*True", m[1]):
            out.append(_row("bazel", f["name"], exact(re.sub(r"\.bcr\.\d+$", "", f.get("version", "")))))
    return out


def kernel_makefile(text: str) -> list[dict]:
    f = dict(re.findall(r"(?m)^(VERSION|PATCHLEVEL|SUBLEVEL|NAME)\s*=\s*(.*?)\s*$", text))
    parts = [f[k] for k in ("VERSION", "PATCHLEVEL", "SUBLEVEL") if f.get(k, "").isdigit()]
    return [_row("kbuild", "kernel", ".".join(parts))] if len(parts) > 1 else []


def recipe_makefile(text: str) -> list[dict]:
    """OpenWrt's ``PKG_*`` and Buildroot's ``<NAME>_VERSION``; computed versions are none."""
    if "PKG_NAME" in text:
        f = dict(re.findall(r"(?m)^(PKG_\w+)\s*:?=\s*(.*?)\s*$", text))
        return [_row("openwrt", f["PKG_NAME"], exact(f.get("PKG_VERSION")), url=f.get("PKG_SOURCE_URL"))] if f.get("PKG_NAME") else []
    return [_row("buildroot", m[1].lower().replace("_", "-"), exact(m[2])) for m in re.finditer(r"(?m)^([A-Z0-9_]+)_VERSION\s*=\s*(.*?)\s*$", text)]


def openharmony(text: str) -> list[dict]:
    data = json.loads(text)
    return [_row("openharmony", x["Name"], exact(x.get("Version Number")), url=x.get("Upstream URL")) for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict) and x.get("Name")]


def rtthread_packages(text: str) -> list[dict]:
    return [_row("rtthread", p["name"], release_tag(p.get("ver"))) for p in json.loads(text) if p.get("name")]


def yocto_manifest(text: str) -> list[dict]:
    rows = [x.split() for x in text.splitlines()]
    return [_row("yocto", r[0], re.sub(r"-r\d+(\.\d+)*$", "", re.sub(r"^\d+:", "", r[2]))) for r in rows if len(r) == 3]


def zephyr_module(text: str) -> list[dict]:
    m = re.search(r"(?m)^name:\s*(\S+)", text)
    return [_row("zephyr", m[1], None)] if m else []


def cmsis_pack(text: str) -> list[dict]:
    name, first = re.search(r"<name>\s*([^<]+?)\s*</name>", text), re.search(r'<release\s[^>]*?version="([^"]+)"', text)
    return [_row("cmsis-pack", name[1], first and first[1])] if name else []


#: Which reader takes which file, by the end of its path; the first that fits.
READERS: list[tuple[str, Callable[[str], list[dict]]]] = [
    (r"/Cargo\.lock$", cargo_lock), (r"/(?:dpkg/status|opkg/status)$", dpkg_status), (r"/apk/db/installed$", apk_installed), (r"/vcpkg\.json$", vcpkg_json), (r"\.wrap$", meson_wrap),
    (r"/CMakeLists\.txt$|\.cmake$", cmake_lists), (r"/library\.properties$", arduino_properties), (r"/platformio\.ini$", platformio_ini), (r"/dependencies\.lock$", idf_lock), (r"/conan\.lock$", conan_lock),
    (r"/conanfile\.txt$", conan_txt), (r"/MODULE\.bazel$", bazel_module), (r"/README\.OpenSource$", openharmony), (r"/packages/pkgs\.json$", rtthread_packages), (r"/deploy/.*\.manifest$", yocto_manifest),
    (r"/zephyr/module\.ya?ml$", zephyr_module), (r"\.pdsc$", cmsis_pack), (r"/Makefile$", lambda t: kernel_makefile(t) or recipe_makefile(t)), (r"\.mk$", recipe_makefile),
]


def read_declared(path: str, text: str) -> list[dict]:
    """A broken file declares nothing."""
    for pattern, reader in READERS:
        if re.search(pattern, path):
            try:
                return reader(text)
            except (ValueError, KeyError, TypeError, AttributeError):
                return []
    return []


def declarations(files: DataFrame) -> DataFrame:
    """``path, ecosystem, name, version, purl, url`` of every known file among ``files(path, text)``."""
    known = "|".join(f"(?:{p})" for p, _ in READERS)
    return per_file(files.filter(F.col("path").rlike(known)), read_declared, SCHEMA, with_path=True)
