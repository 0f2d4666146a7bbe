"""Which paths a scan leaves out and why: one set of rules, for tasks that walk folders and for catalogs.

Order of the rules: the user's paths, folders without access (in limited mode), the system's own, the user's
library but for what is kept of it, then component by component dependency folders and what lies in
packages, then file types of any length and script, then what is always left out.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names

#: Names of folders that hold dependencies, the system's own roots, and what is kept of library and system.
DEPENDENCIES = (
    "node_modules site-packages .venv venv Pods DerivedData .git .svn .hg bower_components __pycache__ .gradle .cargo .rustup "
    ".npm .pnpm-store .yarn .cache .next .nuxt .build .swiftpm .tox .mypy_cache .pytest_cache .terraform"
).split()
SYSTEM_ROOTS = ("/Library", "/usr", "/bin", "/sbin", "/private", "/opt")
SYSTEM, SYSTEM_KEPT = "/System", "/System/Applications"
LIBRARY_KEPT = ("Mobile Documents", "CloudStorage")
RESTRICTED = ("Containers", "Group Containers", "Daemon Containers", "Mobile Documents", "CloudStorage")
ALWAYS_NAMES = (".Spotlight-V100", ".fseventsd", ".DocumentRevisions-V100", ".TemporaryItems", ".Trashes", ".MobileBackups")


def _under(path: str, top: str) -> bool:
    return top == "/" or path == top or path.startswith(f"{top}/")


def _lies(path: Column, top: str) -> Column:
    return F.lit(True) if top == "/" else (path == top) | path.startswith(f"{top}/")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


@dataclass(frozen=True)
class Scope:
    """The rules; paths are absolute, without a slash at the end. None stands for a rule that is off."""

    user_paths: tuple[str, ...] = ()
    library: str | None = None
    limited: bool = False
    system_roots: tuple[str, ...] | None = SYSTEM_ROOTS
    system: str | None = SYSTEM
    system_kept: str = SYSTEM_KEPT
    dependencies: tuple[str, ...] | None = tuple(DEPENDENCIES)
    packages: bool = False  # whether packages are entered
    extensions: tuple[str, ...] = ()
    always_paths: tuple[str, ...] = ()
    always_names: tuple[str, ...] = ALWAYS_NAMES

    def _restricted(self) -> list[str]:
        return [f"{self.library}/{x}" for x in RESTRICTED] if self.limited and self.library else []

    def _types(self) -> list[str]:
        return sorted({unicodedata.normalize(form, e.lower()) for e in self.extensions for form in ("NFC", "NFD")})

    def reason_of(self, path: str, is_dir: bool) -> str | None:
        """Why a path is left out, None if it is not; for use in a task."""
        if any(_under(path, p) for p in self.user_paths):
            return "user path"
        if any(_under(path, p) for p in self._restricted()):
            return "no access"
        if any(_under(path, p) for p in self.system_roots or ()):
            return "system"
        if self.system and _under(path, self.system) and path != self.system and not _under(path, self.system_kept):
            return "system"
        if self.library and _under(path, self.library) and path != self.library and path[len(self.library) + 1 :].partition("/")[0] not in LIBRARY_KEPT:
            return "library"
        parts = [x for x in path.split("/") if x]
        for k, part in enumerate(parts, 1):
            if (k < len(parts) or is_dir) and part in (self.dependencies or ()):
                return "dependency"
            if not self.packages and k < len(parts) and "." in part and part.rpartition(".")[2].translate(names.ASCII_LOWER) in names.PACKAGES:
                return "package"
        name = parts[-1] if parts else ""
        if not is_dir and "." in name and name.rpartition(".")[2].lower() in self._types():
            return "file type"
        if any(_under(path, p) for p in self.always_paths) or any(x in self.always_names for x in (parts if is_dir else parts[:-1])):
            return "built in"
        return None

    def reason(self, path: Column, is_dir: Column) -> Column:
        """The same as a Column."""
        parts = F.filter(F.split(path, "/"), lambda x: x != "")
        last = F.size(parts)
        hits = F.transform(
            parts,
            lambda x, k: F.when(((k + 1 < last) | is_dir) & x.isin(*(self.dependencies or ("",))), "dependency").when(F.lit(not self.packages) & (k + 1 < last) & names.is_package(x), "package"),
        )
        out = F.when(_any([_lies(path, p) for p in self.user_paths]), "user path").when(_any([_lies(path, p) for p in self._restricted()]), "no access")
        out = out.when(_any([_lies(path, p) for p in self.system_roots or ()]), "system")
        if self.system:
            out = out.when(_lies(path, self.system) & (path != self.system) & ~_lies(path, self.system_kept), "system")
        if self.library:
            child = F.substring_index(F.substring(path, len(self.library) + 2, 2**31 - 1), "/", 1)
            out = out.when(_lies(path, self.library) & (path != self.library) & ~child.isin(*LIBRARY_KEPT), "library")
        inner = F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))
        name = F.coalesce(F.element_at(parts, -1), F.lit("")) if self.extensions else F.lit("")
        typed = ~is_dir & name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*(self._types() or [""]))
        held = F.when(is_dir, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(last - 1, F.lit(0))))
        always = _any([_lies(path, p) for p in self.always_paths]) | F.exists(held, lambda x: x.isin(*(self.always_names or ("",))))
        return out.when(inner.isNotNull(), inner).when(typed, "file type").when(always, "built in")

    def filters_files(self, folder: str) -> bool:
        """Whether plain files right in a folder are left out, although it is entered."""
        return folder in (self.system, self.library)
