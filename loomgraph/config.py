"""Engine settings: thresholds and name lists of the analyses."""

from __future__ import annotations

from dataclasses import dataclass

# Names and thresholds that decide the results.
FORBIDDEN_PACKAGES = ("util", "utils", "helper", "helpers", "manager", "managers", "misc", "base")
FORBIDDEN_CLASS_PATTERNS = ("Helper", "Manager", "Utils", "Util")
EXCLUDED_SCOPES = (
    "archives",
    "default",
    "kotlinBuildToolsApiClasspath",
    "kotlinCompilerClasspath",
    "kotlinCompilerPluginClasspath",
    "kotlinCompilerPluginClasspathMain",
    "kotlinCompilerPluginClasspathTest",
    "kotlinKlibCommonizerClasspath",
    "kotlinNativeCompilerPluginClasspath",
    "kotlinScriptDef",
    "kotlinScriptDefExtensions",
)

# Calls of a build script that declare no dependency.
SKIPPED_CALLS = tuple(
    "plugins kotlin id version apply repositories mavenCentral google gradlePluginPortal mavenLocal java tasks register named configure "
    "sourceSets dependencies buildscript allprojects subprojects project files fileTree exclude include create getting creating withType matching "
    "println print error require check listOf setOf mapOf mutableListOf mutableSetOf buildList buildString buildMap run let also apply with".split()
)


@dataclass(frozen=True)
class EngineConfig:
    """forbidden_*: the defaults, or what extended() adds to or puts in their place."""

    forbidden_packages: tuple[str, ...] = FORBIDDEN_PACKAGES
    forbidden_class_patterns: tuple[str, ...] = FORBIDDEN_CLASS_PATTERNS
    excluded_scopes: tuple[str, ...] = EXCLUDED_SCOPES
    max_imports: int = 30
    max_methods: int = 25
    max_lines: int = 1000
    min_depth: int = 3
    cycle_findings: int = 10
    untested_before_summary: int = 10
    untested_preview: int = 5
    project_hubs: int = 15
    workspace_hubs: int = 30
    chain_hops: int = 6

    def extended(self, packages=(), class_patterns=(), replace_defaults: bool = False) -> EngineConfig:
        base = ((), ()) if replace_defaults else (self.forbidden_packages, self.forbidden_class_patterns)
        both = [tuple(dict.fromkeys([*a, *b])) for a, b in zip(base, (packages, class_patterns), strict=True)]
        return EngineConfig(**{**self.__dict__, "forbidden_packages": both[0], "forbidden_class_patterns": both[1]})
