"""Columns on texts: what is embedded, shown, asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltloom.functions.paths import basename, dirname

SPACE = " \t\n\r\f\v"
CLASS_LIMIT, EMBED_CODE_LIMIT, SQL_LIMIT, EMBED_LIMIT, CONTEXT_LIMIT, PREVIEW, KEY, RELATIONS = 12000, 6000, 6000, 20000, 12000, 500, 120, 20

# Patterns of chat commands and questions, word lists.
REPO = r"[\w.-]+/[\w.-]+"
BRANCH = r"(?i)(?:rama|branch)\s+(\S+)"
_ASK = r"\b(?:(?:genera?|crea?|descarga?|exporta?|guarda?|mostra?)(?:r|me)?|sacar|dame|hazme|preparame|armame)\b"
PDF = rf"(?i){_ASK}.*?\bpdf\b"
MARKDOWN = rf"(?i){_ASK}.*?\b(?:markdown|md|\.md)\b"
GRAPH = r"(?i)^\s*grafo\s+([A-Z][a-zA-Z0-9]*)\s*$"
REPO_LIST = r"(?i)^\s*(?:repos|repositorios|listar\s+repos?)\s*$"
INDEX = ("indexa ", "indexar ", "reindexa ", "reindexar ", "index ")
IMPLEMENTATION = r"(?iu)\b(?:m[oó]dulo|module|implementaci[oó]n|implementation|expl[íi]came|explica|c[oó]mo\s+funciona|queries?|sql|dao|repositorio|service|servicio|m[eé]todos?|clase|class|business\s+logic|l[oó]gica)\b"
MODULE_PATH = r"[\w-]+/[\w-]+/([\w-]+)"
# Ends of class names that count even after capitals only; longer names are told by their parts.
SUFFIXES = (
    "Impl Dao Service Repository Mapper Controller Dto Entity Config Util Factory Handler Listener Task Job Batch Processor Writer Reader Interceptor "
    "Filter Servlet Endpoint Client Provider Delegate Adapter Facade Builder Validator Converter Formatter Parser Renderer Generator Exporter Importer "
    "Scheduler Monitor Tracker Logger Auditor Security Session Token Resolver Locator Registry Cache Pool Queue Stack Map Tree Graph Node Connection "
    "Transaction Context Event Message Command Query Request Response Result Source Target Reference Wrapper Proxy Stub Mock Spy Matcher Verifier Checker "
    "Tester Inspector Reviewer Normalizer Sanitizer Cleaner Splitter Joiner Merger Sorter Ranker Scorer Evaluator Calculator Computer Estimator Predictor "
    "Classifier Clusterer Finder Searcher Indexer Extractor Loader Saver Persister Retriever Updater Deleter Creator Destroyer Initializer Finalizer "
    "Activator Deactivator Enabler Disabler Opener Closer Starter Stopper Launcher Runner Executor Invoker Caller Dispatcher Router Balancer Distributor "
    "Allocator Assigner Configurer Setter Getter Accessor Mutator Maker Producer Consumer Subscriber Publisher Emitter Receiver Sender Manager Exception Helper"
).split()
STOPWORDS = (
    "este esta estos estas ese esa esos esas aquel aquella aquellos aquellas de del al el la los las un una unos unas y o que en con por para como es son "
    "lo le me te se si no mas más pero sino todo toda todos todas aqui aquí ahí allí donde cuando quien cual cuyo muy tan tanto cada alguno alguna algunos "
    "algunas ninguno ninguna mismo misma mismos mismas tal tales otro otra otros otras cualquiera demas demás poco poca pocos pocas mucho mucha muchos "
    "muchas varios varias bastante hace hecho haber tener tiene tenido ser estar estoy está estan están era eran fue fueron sea sean sido siendo habiendo "
    "teniendo haciendo dando viendo poder puede pueden podria podría podrian podrían debe deben debiera debieran deberia debería deberian deberían decir "
    "diciendo dicho ver visto dar dado ir yendo ido venir viniendo venido querer queriendo querido saber sabiendo sabido pensar pensando pensado generame "
    "dame hazme mostrame creame descargame exportame guardame preparame armame haz muestra genera crea descarga exporta guarda prepara arma markdown archivo "
    "formato pdf"
).split()
# What a question must hold to get a bundle of technical words, and the bundle.
BUNDLES = (
    (("query", "queries", "sql", "jpql", "select", "insert", "update"), "SQL query database DAO implementation"),
    (("módulo", "modulo", "module", "implementación", "implementation", "explícame", "explica", "cómo funciona"), "Java class implementation methods business logic DAO service"),
    (("dao", "repositorio", "repository"), "DAO implementation database queries"),
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def truncate(c: Column, n: int, notice: Column | str = "") -> Column:
    """The first n characters, and the notice, if there are more."""
    notice = F.lit(notice) if isinstance(notice, str) else notice
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), notice)).otherwise(c)


def class_notice(code: Column) -> Column:
    return F.concat(F.lit("\n... (clase truncada, "), F.length(code).cast("string"), F.lit(" chars totales) ..."))


def entity_id(repo: Column, branch: Column, path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (repo, branch, path, kind, name)])


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def chunk_embed_text(repo: Column, branch: Column, path: Column, language: Column, content: Column) -> Column:
    """What is embedded of a chunk: where it is from, words of its folders, a hint by language, the content."""
    folders = F.array_join(F.filter(F.split(F.translate(dirname(path), "/-_", "   "), r"\s+"), lambda w: w != ""), " ")
    hint = (
        F.when(language == "java", F.concat(F.lit("Java class "), stem(path), F.lit(". Implementation. Business logic. ")))
        .when(language == "sql", F.concat(F.lit("SQL query "), stem(path), F.lit(". Database query. SELECT INSERT UPDATE DELETE. ")))
        .when(language.isin("html", "jsp", "vue", "xml"), F.concat(F.lit("View template "), stem(path), F.lit(". Frontend UI. ")))
        .otherwise("")
    )
    return F.concat(F.lit("Repository: "), repo, F.lit("\nBranch: "), branch, F.lit("\nFile: "), path, F.lit("\nModule context: "), folders, F.lit("\nLanguage: "), language, F.lit("\n"), hint, F.lit("\n"), content)


def entity_embed_text(e: str = "") -> Column:
    """What is embedded of an entity; columns of the entity table, optionally below the struct ``e``."""
    c = lambda name: F.col(f"{e}.{name}" if e else name)
    line = lambda label, x: F.concat(F.lit(label), x)
    filled = lambda x: x.isNotNull() & (x != "")
    relations = F.coalesce(c("relations"), F.array())
    code = F.coalesce(c("code"), F.lit(""))
    lines = F.concat(
        F.array(F.concat(F.lit("Repository: "), c("repo"), F.lit(" Branch: "), c("branch")), line("File: ", c("file_path")), line("Language: ", c("language")), F.concat(c("type"), F.lit(": "), c("name"))),
        F.when(filled(c("signature")), F.array(line("Signature: ", c("signature")))).otherwise(F.array().cast("array<string>")),
        F.when(filled(c("docstring")), F.array(line("Documentation: ", c("docstring")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(c("annotations")) > 0, F.array(line("Annotations: ", F.array_join(c("annotations"), ", ")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(relations, 1, RELATIONS), lambda r: F.concat_ws(" ", r["type"], r["target_type"], r["target_name"])),
        F.when(F.size(relations) > RELATIONS, F.array(F.concat(F.lit("... and "), (F.size(relations) - RELATIONS).cast("string"), F.lit(" more relations")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("Code:"), truncate(code, EMBED_CODE_LIMIT, F.concat(F.lit("\n... ("), F.length(code).cast("string"), F.lit(" chars total) ...")))),
    )
    return F.array_join(lines, "\n")


def signature_of(code: Column, language: Column) -> Column:
    """The text before the first colon (Python) or brace (others)."""
    return strip(F.when(language == "python", F.split_part(code, F.lit(":"), F.lit(1))).otherwise(F.split_part(code, F.lit("{"), F.lit(1))))


def annotation_name(text: Column) -> Column:
    return F.split_part(F.ltrim(text, F.lit("@")), F.lit("("), F.lit(1))


def sql_refs(text: Column) -> Column:
    """Quoted names that end in .sql, in order, without leading slashes."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)[\"']([^\"']*\\.sql)[\"']"), F.lit(1)), lambda r: F.ltrim(r, F.lit("/")))


def first_repo(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, REPO, 0), F.lit(""))


def first_branch(query: Column, default: str = "prod") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(query, BRANCH, 1), F.lit("")), F.lit(default))


def name_candidates(query: Column, most: int = 5) -> Column:
    """Distinct capitalised identifiers of over two characters, in text order."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(r"\b[A-Z][a-zA-Z0-9]*\b"), F.lit(0)), lambda w: F.length(w) > 2)), 1, most)


def class_names(query: Column, most: int = 3, suffixes: list[str] | None = None) -> Column:
    """Names of classes, in text order: identifiers of two capitalised parts or more, whatever the last one is, and those that end in one of SUFFIXES after capitals only (``ABImpl``).

    With ``suffixes`` those that end in one of these alone.
    """
    parts = [] if suffixes else ["[a-z0-9][A-Z][a-zA-Z0-9]*"]
    return F.slice(F.array_distinct(F.regexp_extract_all(query, F.lit(rf"\b([A-Z][a-zA-Z0-9]*(?:{'|'.join([*parts, *(suffixes or SUFFIXES)])}))\b"), F.lit(1))), 1, most)


def keywords(query: Column, most: int = 12) -> Column:
    """Capitalised words of over two characters, then words of four letters or more but stopwords and verb forms."""
    names = F.filter(F.regexp_extract_all(query, F.lit(r"\b[A-Z][a-zA-Z0-9]*\b"), F.lit(0)), lambda w: F.length(w) > 2)
    words = F.filter(
        F.regexp_extract_all(query, F.lit(r"\b[a-zA-Záéíóúñ]{4,}\b"), F.lit(0)),
        lambda w: ~F.lower(w).isin(STOPWORDS) & ~F.lower(w).rlike("(?:ando|iendo|ado|ido)$"),
    )
    return F.slice(F.array_distinct(F.concat(names, words)), 1, most)


def enrich_query(query: Column) -> Column:
    """Questions about an implementation get the module's name and up to three bundles of technical words."""
    module = F.regexp_replace(F.nullif(F.regexp_extract(query, MODULE_PATH, 1), F.lit("")), "-", " ")
    asked = lambda words: F.lower(query).rlike("|".join(words))
    return F.when(query.rlike(IMPLEMENTATION), F.concat_ws(" ", query, module, *[F.when(asked(words), bundle) for words, bundle in BUNDLES])).otherwise(query)


def entity_card(kind: Column, path: Column, signature: Column, name: Column, relations: Column) -> Column:
    """An entity as text: type, file, signature, one bullet for each relation (rel_type, target_name, target_type)."""
    head = F.concat(F.lit("## Grafo de dependencias: "), name, F.lit("\n\n**Tipo:** "), F.coalesce(kind, F.lit("Unknown")), F.lit(" | **Archivo:** `"), F.coalesce(path, F.lit("N/A")), F.lit("`"))
    signed = F.coalesce(F.when(signature != "", F.concat(F.lit("\n**Firma:** `"), signature, F.lit("`"))), F.lit(""))
    bullets = F.array_join(F.transform(relations, lambda r: F.concat(F.lit("- **"), r["rel_type"], F.lit("** → `"), r["target_name"], F.lit("` ("), r["target_type"], F.lit(")"))), "\n")
    return F.concat(head, signed, F.lit("\n\n"), F.when(F.size(relations) > 0, F.concat(F.lit("### Relaciones directas:\n"), bullets)).otherwise("Sin relaciones directas indexadas."))


def intent(query: Column) -> Column:
    return (
        F.when(F.lower(query).rlike("^(?:" + "|".join(INDEX) + ")") & (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) > 1), "index")
        .when(query.rlike(MARKDOWN), "markdown").when(query.rlike(PDF), "pdf").when(query.rlike(GRAPH), "graph").when(query.rlike(REPO_LIST), "repos").otherwise("question")
    )


def index_arguments(query: Column) -> tuple[Column, Column]:
    """Repo and branch (HEAD) of an index command."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(2)), F.coalesce(F.try_element_at(words, F.lit(3)), F.lit("HEAD"))


def message_text(content: Column) -> Column:
    """A plain string, or the first part's text of a JSON list of parts."""
    return strip(F.coalesce(F.when(content.startswith("["), F.get_json_object(content, "$[0].text")), content))


def context_fragment(n: Column, hit: str = "") -> Column:
    """One numbered fragment of a context: where it is from, then the text in a fence."""
    c = lambda name: F.col(f"{hit}.{name}" if hit else name)
    shown = lambda name, default: F.coalesce(c(name), F.lit(default))
    some = lambda name, text: F.when(c(name).isNotNull() & (c(name) != ""), text)
    place = F.concat(F.lit("Score: "), F.format_string("%.3f", F.coalesce(c("score"), F.lit(0.0))), F.lit(" | Source: "), shown("source", "unknown"), F.lit(" | Repo: "), shown("repo", "unknown"), F.coalesce(some("branch", F.concat(F.lit(" | Rama: "), c("branch"))), F.lit("")), F.lit(" | Archivo: "), shown("file_path", "unknown"))
    meta = F.concat_ws(" | ", place, some("ast_name", F.concat(F.lit("Entidad: "), shown("ast_type", ""), F.lit(" "), c("ast_name"))), some("ast_signature", F.concat(F.lit("Firma: "), c("ast_signature"))))
    return F.concat(F.lit("[Fragmento "), n.cast("string"), F.lit("] "), meta, F.lit("\n```\n"), F.substring(shown("text", ""), 1, CONTEXT_LIMIT), F.lit("\n```"))
