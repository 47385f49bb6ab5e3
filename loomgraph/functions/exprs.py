"""Column expressions for names, packages, roles and source text; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation -> role, name ending -> role, package segment -> layer.
ANNOTATION_ROLES = {
    "RestController": "CONTROLLER",
    "Controller": "CONTROLLER",
    "RequestMapping": "CONTROLLER",
    "Service": "SERVICE",
    "Repository": "REPOSITORY",
    "Entity": "ENTITY",
    "Table": "ENTITY",
    "Configuration": "CONFIGURATION",
    "SpringBootApplication": "CONFIGURATION",
    "Dao": "DAO",
    "Database": "DAO",
}
ENDING_ROLES = {"Manager": "MANAGER", "Helper": "HELPER", "Util": "UTIL", "Utils": "UTIL", "Utility": "UTIL"}
LAYERS = {
    "PRESENTATION": ("task", "ui", "screen", "view", "route", "controller", "activity", "fragment"),
    "DOMAIN": ("usecase", "interactor", "service", "workflow"),
    "DATA": ("repository", "datasource", "api", "db", "cache", "dao"),
    "MODEL": ("model", "entity", "dto", "domain"),
    "INFRASTRUCTURE": ("config", "configuration", "di", "injection", "plugin"),
    "TEST": ("test", "mock", "fake", "stub", "fixture"),
}
PLATFORM_IMPORTS = r"^(java|javax|kotlin|kotlinx)\."


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def before_last(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.left(name, F.length(name) - F.length(last_segment(name)) - 1)).otherwise(F.lit(""))


def qualified(package: Column, name: Column) -> Column:
    return F.when(package != "", F.concat(package, F.lit("."), name)).otherwise(name)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def code_lines(text: Column) -> Column:
    """Lines that are neither blank, `//` comments nor part of a block comment that opens a line."""

    def step(acc: Column, line: Column) -> Column:
        t = trimmed(line)
        closes = t.contains("*/")
        n, block = acc["n"], acc["block"]
        counted = ~block & ~t.startswith("/*") & (t != "") & ~t.startswith("//")
        return F.struct(F.when(counted, n + 1).otherwise(n).alias("n"), F.when(block | t.startswith("/*"), ~closes).otherwise(F.lit(False)).alias("block"))

    return F.aggregate(lines(text), F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("block")), step)["n"]


def strip_comments(text: Column) -> Column:
    """Without block comments and lines that begin with `//`."""
    rest = F.regexp_replace(text, r"/\*[\s\S]*?\*/", "")
    return F.array_join(F.filter(F.split(rest, "\n"), lambda x: ~F.regexp_replace(x, r"^\s+", "").startswith("//")), "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1 plus the number of line feeds before a zero-based offset."""
    head = F.left(text, offset)
    return F.lit(1) + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def annotation_role(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ANNOTATION_ROLES.items() for x in kv])
    return F.element_at(table, last_segment(name))


def name_role(name: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(name.endswith(kv[0]), kv[1]), ENDING_ROLES.items(), F.when(F.lit(False), "")).otherwise("OTHER")


def layer(package: Column, is_test: Column | None = None) -> Column:
    """Layer that a package's last segment names; what is known to be a test is TEST whatever its package."""
    last = F.lower(last_segment(package))
    first = F.when(F.lit(False) if is_test is None else F.coalesce(is_test, F.lit(False)), "TEST")
    return reduce(lambda acc, kv: acc.when(last.isin(*kv[1]), kv[0]), LAYERS.items(), first).otherwise("OTHER")


def is_test_path(path: Column) -> Column:
    return path.contains("/test/") | path.contains("\\test\\")


def node_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def enum_like(name: Column) -> Column:
    """Named as a constant: capitals, digits and underscores only, or with a dot."""
    return name.rlike(r"^[\p{Lu}\p{Nd}_]+$") | name.contains(".")


def interface_like(name: Column) -> Column:
    """Named as an interface: a role ending, or I and a capital; not an enum-like constant."""
    return ~enum_like(name) & (name.rlike("(Service|Repository|Provider|Factory)$") | name.rlike(r"^I[A-Z]") & (F.length(name) > 2))


def mock_like(name: Column) -> Column:
    return F.lower(name).rlike("^(mock|fake|stub)|(mock|fake|stub)$")


def relative_path(package: Column, file_name: Column) -> Column:
    """The directory a package implies, with the file's name."""
    return F.when(package != "", F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/"), file_name)).otherwise(file_name)


def report_path(project: Column) -> Column:
    path = F.regexp_replace(F.replace(project, F.lit(":"), F.lit("/")), "^/+", "")
    return F.when(path == "", "root").otherwise(path)


def external_build(path: Column, other: Column) -> Column:
    a, b = F.substring_index(path, "/", 1), F.substring_index(other, "/", 1)
    return (a != "") & (b != "") & (a != b)
