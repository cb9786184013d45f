"""Column expressions over paths, identifiers and source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "cs": "c_sharp", "csx": "c_sharp",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell",
    "ps1": "powershell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "css": "css",
    "scss": "scss", "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "rb": "ruby", "php": "php", "dart": "dart", "lua": "lua", "r": "r",
}
# Languages that aren't source code.
DOCUMENT_LANGUAGES, CONFIG_LANGUAGES = {"markdown"}, {"json", "yaml", "toml", "xml"}
CODE_LANGUAGES = sorted(set(LANGUAGES.values()) - DOCUMENT_LANGUAGES - CONFIG_LANGUAGES)

# Paths of generated files, as regular expressions.
GENERATED = [
    r"\.pb\.go$", r"_grpc\.pb\.go$", r"_mock\.go$", r"mock_[^/\\]+\.go$", r"_string\.go$", r"_gen\.go$", r"wire_gen\.go$", r"ent/[^/\\]+\.go$",
    r"zzgenerated[^/\\]*\.go$", r"zz_generated[^/\\]*\.go$", r"\.generated\.(ts|js|tsx|jsx)$", r"\.g\.(ts|js)$", r"__generated__",
    r"generated/[^/\\]+\.(ts|js|tsx|jsx)$", r"dist/[^/\\]+\.(js|mjs|cjs)$", r"\.next/", r"\.nuxt/", r"_pb2\.py$", r"_pb2_grpc\.py$", r"_generated\.py$",
    r"\.pb\.(h|cc|cpp)$", r"\.grpc\.pb\.(h|cc|cpp)$", r"moc_[^/\\]+\.cpp$", r"ui_[^/\\]+\.h$", r"\.tab\.(c|h)$", r"lex\.yy\.c$", r"\.Designer\.cs$",
    r"\.g\.cs$", r"\.generated\.cs$", r"Migrations/[^/\\]+\.cs$", r"generated-sources/", r"target/generated/", r"build/generated/",
    r"\.generated\.swift$", r"Generated/[^/\\]+\.swift$", r"\.g\.dart$", r"\.freezed\.dart$", r"target/[^/\\]+/build/", r"vendor/", r"node_modules/", r"__pycache__/",
]
GENERATED_PENALTY = 0.3


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` where there is none."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def is_generated(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike("|".join(f"(?:{p})" for p in GENERATED))


def generated_penalty(path: Column, score: Column) -> Column:
    return F.when(is_generated(path), score * F.lit(GENERATED_PENALTY)).otherwise(score)


def nws(text: Column) -> Column:
    """Characters that are no space, tab, line feed or carriage return."""
    return F.length(F.translate(text, " \t\n\r", ""))


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.left(content, offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Lower-cased base name without its last extension; a leading dot is no extension."""
    return F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def camel_to_snake(token: Column) -> Column:
    once = F.regexp_replace(token, "([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(once, "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def snake_to_camel(token: Column) -> Column:
    """An underscore before a lower-case letter goes, and the letter becomes a capital."""
    parts = F.split(F.lower(token), "_")
    joined = F.transform(parts, lambda p, k: F.when(k == 0, p).when(p.rlike("^[a-z]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))).otherwise(F.concat(F.lit("_"), p)))
    return F.array_join(joined, "")


def query_variants(token: Column) -> Column:
    """Lower case, without separators, snake case of camel case and camel case of snake case."""
    low = F.lower(token)
    bare = F.lower(F.translate(token, "._-", ""))
    return F.array_distinct(
        F.filter(
            F.array(low, F.when((bare != low) & (bare != ""), bare), F.when(token.rlike("[a-z][A-Z]"), camel_to_snake(token)), F.when(token.contains("_"), snake_to_camel(token))),
            lambda v: v.isNotNull(),
        )
    )


def sanitise_query(query: Column) -> Column:
    """Query without operators and special characters, spaces collapsed."""
    plain = F.regexp_replace(query, r'[():"*^./\\:@#$%&=+\[\]{}<>|~`!?,;]', " ")
    plain = F.regexp_replace(plain, r"(?i)\b(AND|OR|NOT|NEAR)\b", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def query_tokens(query: Column) -> Column:
    """Distinct tokens of a query: variants of code-like tokens, then of its words.

    Words are runs of letters, digits and underscores; a dictionary segmentation of
    scripts without spaces is out of reach of the built-in functions.
    """
    clean = sanitise_query(query)
    code = F.filter(F.split(query, r"\s+"), lambda t: t.rlike("[._/]") | t.rlike("[a-z][A-Z]"))
    words = F.regexp_extract_all(clean, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    every = F.array_distinct(F.flatten(F.transform(F.concat(code, words), query_variants)))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(every)


def symbol_tokens(text: Column) -> Column:
    """Identifiers of a text with their case variants, in order of first sight."""
    names = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    variants = F.transform(F.array_distinct(names), lambda t: F.array(t, F.lower(t), F.when(t.rlike("[a-z][A-Z]"), camel_to_snake(t)), F.when(t.contains("_"), snake_to_camel(t))))
    return F.array_distinct(F.filter(F.flatten(variants), lambda v: v.isNotNull() & (v != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def token_overlap(text: Column, tokens: list[str]) -> Column:
    """1 for each token that stands as a word of ASCII letters, digits and underscores, 0.5 for each other token that occurs."""
    low = F.lower(text)
    parts = [F.when(low.contains(t), F.when(low.rlike(_as_word(t)), 1.0).otherwise(0.5)).otherwise(0.0) for t in tokens if t]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _as_word(token: str) -> str:
    """The token between word boundaries, which depend on whether its ends are word characters."""
    edge = lambda c, inner, outer: inner if c.isascii() and (c.isalnum() or c == "_") else outer
    before, after = edge(token[0], r"(?<![A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])"), edge(token[-1], r"(?![A-Za-z0-9_])", r"(?=[A-Za-z0-9_])")
    return f"{before}{_quoted(token)}{after}"


def _quoted(token: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|()[]{}*+?-" else c for c in token)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path pattern: ** any run, * any run but /, ? one character but /."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], _quoted(glob[k]))
        k += 1
    return f"^{out}$"


def path_matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path meets any include pattern, if there are such, and no exclude pattern."""
    plain = F.regexp_replace(path, r"\\", "/")
    any_of = lambda globs: plain.rlike("|".join(glob_regex(g) for g in globs))
    good = any_of(include) if include else F.lit(True)
    return good & ~any_of(exclude) if exclude else good


def estimated_tokens(text: Column) -> Column:
    """Characters by 4, or by 3.5 where over 5 % are brackets or punctuation, rounded up."""
    size = F.length(text)
    special = F.length(text) - F.length(F.translate(text, "{}()[];,.<>", ""))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(size / F.when(special / size > 0.05, 3.5).otherwise(4.0))).cast("long")


def project_id(path: Column, born_ms: Column) -> Column:
    """Ten hexadecimal digits that a project's folder and its time of birth give."""
    return F.left(F.md5(F.encode(F.concat_ws("::", path, born_ms.cast("string")), "utf-8")), F.lit(10))


def format_uptime(seconds: Column) -> Column:
    """Days, hours and minutes, from the largest that isn't 0 on; at least minutes."""
    day, hour, minute = F.floor(seconds / 86_400), F.floor(seconds % 86_400 / 3600), F.floor(seconds % 3600 / 60)
    return F.when(day > 0, F.format_string("%dd %dh %dm", day, hour, minute)).when(hour > 0, F.format_string("%dh %dm", hour, minute)).otherwise(F.format_string("%dm", minute))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0).cast("long")).otherwise(half_up((before - after) / before * 100))


def parent_prefix(breadcrumb: Column) -> Column:
    """A breadcrumb without its last part; empty where it has one part only."""
    parts = F.split(breadcrumb, " > ")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def truncate_middle(text: Column, most: int) -> Column:
    half = (most - 3) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half))))


def truncate_head_tail(text: Column, most: int, head: float = 0.67) -> Column:
    first = int(most * head)
    last = most - first - 3
    cut = F.left(text, F.lit(most)) if last <= 0 else F.concat(F.left(text, F.lit(first)), F.lit("..."), F.right(text, F.lit(last)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def format_bytes(size: Column) -> Column:
    """Bytes with one of B, KB, MB or GB."""
    step = lambda n, unit: F.format_string(f"%.2f {unit}", size / F.lit(float(n)))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, step(1024, "KB")).when(size < 1024**3, step(1024**2, "MB")).otherwise(step(1024**3, "GB"))


def format_cost(cost: Column) -> Column:
    return F.when(cost < 0.01, "$0.00").otherwise(F.format_string("$%.2f", cost))


def normalised_import(current: Column, target: Column) -> Column:
    """Path of a relative import seen from a file; a step above the root is null, as is an import that isn't relative."""
    parts = F.concat(F.slice(F.split(current, "/"), 1, F.size(F.split(current, "/")) - 1), F.split(target, "/"))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        up = F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok"))
        return F.when((p == "") | (p == "."), acc).when(p == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(p)).alias("at"), acc["ok"].alias("ok")))

    return F.when(target.startswith("."), F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/"))))
