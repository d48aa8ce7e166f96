"""Comment grammars by file extension, and the keywords that survive identifier flattening."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Grammar:
    """How a language marks comments and literals."""

    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    quotes: tuple[str, ...] = ('"', "'")
    templates: tuple[str, ...] = ("`",)
    regex_literals: bool = False
    block_at_line_start: bool = False
    if_zero: bool = False


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    grammar: Grammar
    keywords: frozenset[str] = field(default_factory=frozenset)


_C_LIKE = Grammar(("//",), ("/*", "*/"), if_zero=True)
_SCRIPT = Grammar(("//",), ("/*", "*/"), regex_literals=True, if_zero=True)
_HASH = Grammar(("#",))
_TAGS = Grammar((), ("<!--", "-->"), quotes=(), templates=())
_SHEET = Grammar(("//",), ("/*", "*/"))

# Keywords that identifier flattening by language keeps. Other languages get theirs by ``register_language`` or ``with_keywords``.
C_KEYWORDS = frozenset(
    "if else for while do switch case break continue return goto struct typedef enum union static const volatile extern register inline"
    " void int long float double char short unsigned signed sizeof true false null define include".split()
)
JAVA_KEYWORDS = frozenset(
    "if else for while do switch case break continue return try catch finally throw throws class interface enum extends implements import package new instanceof"
    " void int long float double char boolean byte short string public private protected default static final abstract synchronized true false null this super".split()
)
SCRIPT_KEYWORDS = frozenset(
    "if else for while do switch case break continue return try catch finally throw function class extends import from var let const new delete instanceof typeof"
    " export default static async await yield true false null this super undefined".split()
)
TYPED_SCRIPT_KEYWORDS = frozenset(
    "interface enum type implements public private protected abstract readonly declare namespace module void string number boolean any never".split()
)
PYTHON_KEYWORDS = frozenset(
    "if else elif for while break continue return try except finally raise with as class def import from lambda yield async await and or not in is"
    " True False None global nonlocal pass del assert true false null self".split()
)
GO_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
    " int string bool float byte true false nil".split()
)

# Extensions and markers of each language.
_BUILT_IN = (
    Language("C", (".c", ".h"), _C_LIKE, C_KEYWORDS),
    Language("C++", (".cpp", ".hpp", ".cc"), _C_LIKE),
    Language("C#", (".cs",), _C_LIKE),
    Language("Java", (".java",), _C_LIKE, JAVA_KEYWORDS),
    Language("Kotlin", (".kt", ".kts"), _C_LIKE),
    Language("Scala", (".scala",), _C_LIKE),
    Language("JavaScript", (".js", ".jsx", ".mjs"), _SCRIPT, SCRIPT_KEYWORDS),
    Language("TypeScript", (".ts",), _SCRIPT, SCRIPT_KEYWORDS | TYPED_SCRIPT_KEYWORDS),
    Language("TSX", (".tsx",), _SCRIPT, SCRIPT_KEYWORDS | TYPED_SCRIPT_KEYWORDS),
    Language("Go", (".go",), _C_LIKE, GO_KEYWORDS),
    Language("Rust", (".rs",), _C_LIKE),
    Language("Swift", (".swift",), _C_LIKE),
    Language("Python", (".py", ".pyw"), _HASH, PYTHON_KEYWORDS),
    Language("Ruby", (".rb",), Grammar(("#",), ("=begin", "=end"), block_at_line_start=True)),
    Language("PHP", (".php",), Grammar(("//", "#"), ("/*", "*/"))),
    Language("Perl", (".pl", ".pm"), _HASH),
    Language("Shell", (".sh", ".bash"), _HASH),
    Language("Lua", (".lua",), Grammar(("--",), ("--[[", "]]"))),
    Language("Zsh", (".zsh",), _HASH),
    Language("R", (".r", ".R"), _HASH),
    Language("HTML", (".html", ".htm"), _TAGS),
    Language("XML", (".xml",), _TAGS),
    Language("SVG", (".svg",), _TAGS),
    Language("CSS", (".css",), Grammar((), ("/*", "*/"), quotes=(), templates=())),
    Language("SCSS", (".scss",), _SHEET),
    Language("LESS", (".less",), _SHEET),
    Language("SQL", (".sql", ".ddl", ".dml", ".pks", ".pkb", ".plsql", ".tsql"), Grammar(("--",), ("/*", "*/"))),
    Language("YAML", (".yaml", ".yml"), _HASH),
    Language("TOML", (".toml",), _HASH),
)

# Keywords kept by identifier flattening in every language.
COMMON_KEYWORDS = tuple(
    "if else for while do switch case break continue return try catch finally throw throws"
    " class interface enum struct typedef extends implements import package from def function var let const static final abstract"
    " void int long float double char boolean bool string byte short"
    " public private protected default"
    " true false null None this self super new delete instanceof typeof sizeof"
    " lambda yield async await with as in not and or is pass raise nonlocal global".split()
)


class Registry:
    """Languages by extension. An extension belongs to one language; lookup is by exact case, callers pass lower case."""

    def __init__(self, languages=_BUILT_IN):
        self._by_extension: dict[str, Language] = {}
        for language in languages:
            self.register(language)

    def register(self, language: Language) -> None:
        taken = [e for e in language.extensions if e in self._by_extension]
        if taken:
            raise ValueError(f"extension already registered: {', '.join(taken)}")
        self._by_extension.update(dict.fromkeys(language.extensions, language))

    def find(self, extension: str) -> Language | None:
        return self._by_extension.get(extension)

    def grammar(self, extension: str) -> Grammar | None:
        found = self.find(extension)
        return found.grammar if found else None

    def keywords(self, extension: str | None) -> frozenset[str]:
        """Keywords of the extension's language, the common ones if it has none; for an unknown extension those of all languages and the common ones."""
        found = self.find(extension or "")
        if found:
            return found.keywords or frozenset(COMMON_KEYWORDS)
        return frozenset(COMMON_KEYWORDS).union(*(x.keywords for x in self._by_extension.values()))

    def with_keywords(self, extension: str, keywords) -> None:
        """Give the language of a known extension its keywords."""
        found = self._by_extension[extension]
        changed = replace(found, keywords=frozenset(keywords))
        self._by_extension.update(dict.fromkeys(found.extensions, changed))

    def grammars(self) -> dict[str, Grammar]:
        """Grammars by extension as they are now: what a function for the workers carries along."""
        return {e: x.grammar for e, x in self._by_extension.items()}

    def extensions(self) -> list[str]:
        return sorted(self._by_extension)


REGISTRY = Registry()


def register_language(language: Language) -> None:
    """Add a language to the registry. Queries planned from now on know it, on the workers too: they carry the grammars along."""
    REGISTRY.register(language)
