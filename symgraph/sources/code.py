"""Source trees as symbol rows: listing, filtering, and extraction over a stream of statements.

Extraction stays in the JVM. Strings and comments are blanked over the whole text first, at
equal length, so that brackets in them do not count and places stay what they are. The code is
cut after every brace, semicolon and line end, and pieces between which a parenthesis is open
are put together again: a statement is what stands between two cuts, however many share a line
or however many lines one takes. Running sums over the statements give the depth of braces, and
the first brace that goes back to a statement's depth ends the block that it opens. A
declaration is a statement that matches its language's pattern at depth 0, or at depth 1
inside a type, and its parent is the type whose block is around it. Nested types end where their block does and are not entered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.schema import CALL_SITES, SYMBOLS
from symgraph.sources.tree import read_tree
from symgraph.storage import materialize

# Directories that are never scanned, sizes and counts beyond which files are left out, endings and their language.
SKIP_DIRS = [
    "node_modules", "target", "build", "dist", ".git", ".gradle", ".idea", ".settings", "bin", "out", "__pycache__", ".next", ".nuxt", "coverage", "test", "tests", "__tests__", "spec", "specs",
    "e2e", "integration-test", "integration-tests", "test-fixtures", "testFixtures", "fixtures",
]
MAX_BYTES, MAX_FILES, MAX_DEPTH = 500_000, 2_000, 8
LANGUAGES = {"java": "java", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "scala": "scala", "sc": "scala", "graphql": "graphql", "gql": "graphql"}
#: Signatures of these languages are cut to so many characters.
SIGNATURE = {"typescript": 200, "tsx": 200, "javascript": 200}
JS = ("typescript", "tsx", "javascript")
FILE = ["module", "file_path"]


def language_of(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))]


def inside(path: Column) -> Column:
    """Does a relative path stay below the root it is relative to?"""
    parts = F.split(path, "/")
    climbs = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["least"], acc["at"] + F.when(p == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    return ~(F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:[\\\\/]")) & (climbs["least"] >= 0)


def _read(spark: SparkSession, root: str) -> DataFrame:
    found = read_tree(spark, root, SKIP_DIRS, MAX_DEPTH, list(LANGUAGES), most=MAX_BYTES)
    # Bytes that are no UTF-8 become replacement characters.
    return found.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumnRenamed("path", "file_path")


def _listed(rows: DataFrame, module: str) -> DataFrame:
    rows = rows.where(F.col("text").rlike("\\S")).withColumn("language", language_of(F.col("file_path")))
    # The first MAX_FILES paths of one module, without their texts.
    first = rows.select("file_path").orderBy("file_path").limit(MAX_FILES)
    numbered = first.select(F.col("file_path").alias("p"), (F.row_number().over(Window.orderBy("file_path")) - 1).alias("file_ord"))
    return rows.join(F.broadcast(numbered), F.col("file_path") == F.col("p")).select(F.lit(module).alias("module"), "file_path", "language", "file_ord", "text", F.sha2("content", 256).alias("hash"))


def source_files(spark: SparkSession, root: str, module: str) -> DataFrame:
    """(module, file_path, language, file_ord, text, hash) of the source files below root.

    Hidden and skipped directories, deep, large and blank files are left out, and links;
    at most MAX_FILES of a module by path.
    """
    return _listed(_read(spark, root), module)


def scanned_files(spark: SparkSession, root: str, module: str) -> tuple[DataFrame, DataFrame]:
    """source_files(), and (module, message) of what could not be read or went beyond MAX_FILES; the tree is read once."""
    rows = materialize(_read(spark, root), "tree")
    total = rows.where(F.col("text").rlike("\\S")).agg(F.count("*").alias("n")).where(F.col("n") > MAX_FILES)
    capped = total.select(F.concat(F.lit(f"Module {module}: "), F.col("n"), F.lit(f" files found, capped to {MAX_FILES}")).alias("message"))
    failed = rows.where("error is not null").select(F.concat(F.lit("Cannot read "), "file_path", F.lit(": "), "error").alias("message"))
    return _listed(rows, module), failed.union(capped).select(F.lit(module).alias("module"), "message")


# Runs that are not code, whichever begins first: text blocks, strings, comments.
_NOISE = "\"\"\"(?s:.*?)\"\"\"|\"(?:[^\"\\\\\\n]++|\\\\.)*+\"|'(?:[^'\\\\\\n]++|\\\\.)*+'|`(?:[^`\\\\]++|\\\\(?s:.))*+`|//[^\\n]*|/\\*(?s:.*?)(?:\\*/|\\z)"
_GRAPHQL_NOISE = "\"\"\"(?s:.*?)\"\"\"|\"(?:[^\"\\\\\\n]++|\\\\.)*+\"|#[^\\n]*"


def _blanked(text: Column, noise: str) -> Column:
    """The text with what is in strings and comments turned into blanks; quotes, lengths and line breaks stay."""
    gaps, runs = F.split(text, noise, -1), F.regexp_extract_all(text, F.lit(noise), F.lit(0))
    kept = F.transform(runs, lambda r: F.when(
        F.substring(r, 1, 1).isin("\"", "'", "`") & (F.length(r) >= 2),
        F.concat(F.lit("\""), F.regexp_replace(F.substring(r, F.lit(2), F.length(r) - 2), "[^\\n]", " "), F.lit("\"")),
    ).otherwise(F.regexp_replace(r, "[^\\n]", " ")))
    return F.array_join(F.zip_with(gaps, kept, lambda g, k: F.concat(g, F.coalesce(k, F.lit("")))), "")


def _count(code: Column, letter: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(letter), F.lit("")))


def _statements(files: DataFrame) -> DataFrame:
    """One row for each statement: its number v, lines n to last, text and code, and the depth of braces ahead of it.

    Strings in code are empty. Blank lines and lines of comments alone are statements of their own.
    """
    text = F.regexp_replace("text", "\\r\\n?", "\n")
    rows = files.select(*FILE, "language", "file_ord", text.alias("text"))
    rows = rows.withColumn("code", F.when(F.col("language") == "graphql", _blanked(F.col("text"), _GRAPHQL_NOISE)).otherwise(_blanked(F.col("text"), _NOISE)))
    listed = F.flatten(F.transform(F.regexp_extract_all("code", F.lit("\\bexport\\s*\\{([^}]*)\\}"), F.lit(1)), lambda names: F.transform(F.split(names, ","), lambda x: F.regexp_extract(x, "(\\w+)", 1))))
    default = F.regexp_extract_all("code", F.lit("\\bexport\\s+default\\s+(\\w+)\\s*;?\\s*(?:\\n|\\z)"), F.lit(1))
    rows = rows.withColumn("exported", F.when(F.col("language").isin(*JS), F.concat(listed, default)))
    package = F.regexp_extract("code", "(?m)^\\s*package\\s+([\\w.]+)", 1)
    rows = rows.withColumn("package_name", F.when(F.col("language").isin("java", "scala") & (package != ""), package))
    whole = [*FILE, "language", "file_ord", "exported", "package_name"]
    rows = rows.select(*whole, F.posexplode(F.arrays_zip(F.split("text", "\n").alias("line"), F.split("code", "\n").alias("code"))).alias("n", "both"))
    pieces = F.regexp_extract_all("both.code", F.lit("[^{};]*[{};]|[^{};]+$"), F.lit(0))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    rows = rows.select(*whole, "n", "both.line", F.size(pieces).alias("pieces"), F.posexplode(pieces).alias("j", "code"))
    order = Window.partitionBy(*FILE).orderBy("n", "j")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("code")).over(before), F.lit(0))).withColumn("rounds", _count(F.col("code"), "(") - _count(F.col("code"), ")"))
    rows = rows.withColumn("begin", F.max(F.when(F.col("j") == 0, F.col("at"))).over(order)).withColumn("open", F.sum("rounds").over(order))
    rows = rows.withColumn("v", F.coalesce(F.sum(F.when(F.col("open") <= 0, 1).otherwise(0)).over(before), F.lit(0)))
    cut = F.when(F.col("j") == F.col("pieces") - 1, "\n").otherwise("")
    rows = rows.select(*whole, "n", "j", "v", F.concat(F.expr("substr(line, at - begin + 1, length(code))"), cut).alias("line"), F.concat("code", cut).alias("code"))
    parts = F.array_sort(F.collect_list(F.struct("n", "j", "line", "code")))
    rows = rows.groupBy(*whole, "v").agg(F.min("n").alias("n"), F.max("n").alias("last"), parts.alias("parts"))
    joined = lambda c: F.regexp_replace(F.array_join(F.transform("parts", lambda p: p[c]), ""), "\\n\\z", "")
    rows = rows.select(*whole, "v", "n", "last", joined("line").alias("line"), joined("code").alias("blank"))
    rows = rows.withColumn("code", F.regexp_replace("blank", "\"[ \\n]*\"", "\"\""))
    order = Window.partitionBy(*FILE).orderBy("v")
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("delta", _count(F.col("code"), "{") - _count(F.col("code"), "}"))
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(ahead), F.lit(0)))
    return rows.withColumn("next_code", F.first(F.when(F.trim("code") != "", F.trim("code")), ignorenulls=True).over(behind))


_MODS = "(?:(?:public|protected|private|static|final|abstract|default|synchronized|override|lazy|implicit|sealed|async|readonly|export|declare|native|transient|volatile|strictfp)\\s+)*"
_NOT_CODE = "(?!\\s*(?:return|new|else|throw|case|package|import|if|for|while|switch|catch|do|try|assert|yield|await|function)\\b)"
_TYPE = "[\\w<>\\[\\],.?]+(?:\\s+[\\w<>\\[\\],.?]+)*?"
_EXPORT = "^\\s*(?:export\\s+)?(?:default\\s+)?(?:declare\\s+)?"
_CLASSES, _ANY = ("class", "interface", "enum", "annotation", "case-class", "trait", "object"), None
#: language -> (kinds of the parent, or None at the top; kind; pattern with the name as group 1); the first match of a line counts.
DECLARATIONS: dict[str, list[tuple[tuple[str, ...] | None, str, str]]] = {
    "java": [
        (_ANY, "class", f"^\\s*{_MODS}(?:class|record)\\s+(\\w+)"), (_ANY, "annotation", f"^\\s*{_MODS}@interface\\s+(\\w+)"), (_ANY, "interface", f"^\\s*{_MODS}interface\\s+(\\w+)"), (_ANY, "enum", f"^\\s*{_MODS}enum\\s+(\\w+)"),
        (("enum",), "constant", "^\\s*([A-Z][A-Z0-9_]*)\\s*(?:\\([^)]*\\))?\\s*(?:[,;{}]|$)"),
        (("class", "enum"), "constructor", f"^{_NOT_CODE}\\s*{_MODS}([A-Z]\\w*)\\s*\\("), (_CLASSES, "method", f"^{_NOT_CODE}\\s*{_MODS}(?:<[^>]+>\\s+)?{_TYPE}\\s+(\\w+)\\s*\\("),
        (_CLASSES, "field", f"^{_NOT_CODE}\\s*{_MODS}{_TYPE}\\s+(\\w+)\\s*(?:=|;)"),
    ],
    "scala": [
        (_ANY, "case-class", f"^\\s*{_MODS}case\\s+class\\s+(\\w+)"), (_ANY, "class", f"^\\s*{_MODS}class\\s+(\\w+)"), (_ANY, "trait", f"^\\s*{_MODS}trait\\s+(\\w+)"), (_ANY, "object", f"^\\s*{_MODS}(?:case\\s+)?object\\s+(\\w+)"), (_ANY, "enum", f"^\\s*{_MODS}enum\\s+(\\w+)"),
        (_CLASSES, "method", f"^\\s*{_MODS}def\\s+(\\w+)"), (_CLASSES, "field", f"^\\s*{_MODS}va[lr]\\s+(\\w+)"),
    ],
    "graphql": [
        (_ANY, "graphql-type", "^\\s*(?:type|union|scalar)\\s+(\\w+)"), (_ANY, "graphql-input", "^\\s*input\\s+(\\w+)"), (_ANY, "interface", "^\\s*interface\\s+(\\w+)"), (_ANY, "graphql-enum", "^\\s*enum\\s+(\\w+)"),
        (("graphql-type", "graphql-input", "interface"), "field", "^\\s*(\\w+)\\s*(?:\\([^)]*\\))?\\s*:"),
    ],
}
_TS = [
    (_ANY, "interface", f"{_EXPORT}interface\\s+(\\w+)"), (_ANY, "class", f"{_EXPORT}(?:abstract\\s+)?class\\s+(\\w+)"), (_ANY, "type", f"{_EXPORT}type\\s+(\\w+)"), (_ANY, "enum", f"{_EXPORT}(?:const\\s+)?enum\\s+(\\w+)"),
    (_ANY, "function", f"{_EXPORT}(?:async\\s+)?function\\s*\\*?\\s*(\\w+)"), (_ANY, "constant", f"{_EXPORT}(?:const|let|var)\\s+(\\w+)"),
    (("class",), "method", f"^{_NOT_CODE}\\s*{_MODS}(?:get\\s+|set\\s+)?(?!constructor\\b)(\\w+)\\s*(?:<[^>]*>)?\\("), (("class",), "field", f"^{_NOT_CODE}\\s*{_MODS}(\\w+)[?!]?\\s*(?::|=|;)"),
    (("interface",), "method", "^\\s*(?:readonly\\s+)?(\\w+)\\??\\s*(?:<[^>]*>)?\\("), (("interface",), "field", "^\\s*(?:readonly\\s+)?(\\w+)\\??\\s*:"), (("enum",), "constant", "^\\s*(\\w+)\\s*(?:=|,|$)"),
]
DECLARATIONS |= {k: _TS for k in JS}
_CONSTANTS = "([A-Z][A-Z0-9_]*)\\s*(?:\\([^)]*\\))?\\s*(?=[,;}]|$)"
_ROOTS = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}
_FUNCTIONS = ("function", "component", "hook")
_CALL = "(?<!\\w)(?<!\\bnew\\s)((?:\\w+\\s*\\.\\s*)?\\w+)\\s*\\("
_NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "function", "super", "this", "new", "synchronized", "throw", "try", "async", "await", "typeof", "in", "of", "void", "delete", "yield", "case", "else", "do"]
#: An annotation with its arguments, parentheses inside them too.
_MARK = "@(?!interface)\\w+(?:\\.\\w+)*(?:\\((?:[^()]|\\((?:[^()]|\\([^()]*\\))*\\))*\\))?"
#: The same in the text itself: strings in the arguments may hold parentheses.
_ARGS = "(?:[^()\"']|\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'"
_RAW_MARK = f"@(?!interface)\\w+(?:\\.\\w+)*(?:\\({_ARGS}|\\({_ARGS}|\\({_ARGS})*\\))*\\))*\\))?"
_API = "(?:\\bfetch|\\b\\w+\\.(get|post|put|delete|patch))\\s*(?:<[^>]*>)?\\(\\s*[\"'`](/[^\"'`]*)"


def _declared(files: DataFrame) -> DataFrame:
    """Statements with the declaration d(kind, name) that each makes, if any, where it ends, its annotations and comment, and its owner."""
    rows = _statements(files)
    rows = rows.withColumn("decl", F.regexp_replace("code", f"^\\s*(?:{_MARK}\\s+)+(?=\\w)", ""))
    order = Window.partitionBy(*FILE).orderBy("v")
    ahead, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)

    def pick(top: bool, owner: Column | None = None) -> Column:
        found = [
            F.when(
                (F.col("language") == lang) & F.col("decl").rlike(pattern) & (F.lit(True) if top else owner.isin(*parents)),
                F.struct(F.lit(kind).alias("kind"), F.regexp_extract("decl", pattern, 1).alias("name")),
            )
            for lang, each in DECLARATIONS.items() for parents, kind, pattern in each if (parents is None) == top
        ]
        return F.coalesce(*found)

    # The statement, and the line, where a block goes back to the depth it was opened at.
    here = F.struct("v", F.col("last").alias("n"))
    closes = lambda floor: F.min(F.when((F.col("depth") + F.col("delta") <= floor) & F.col("code").contains("}"), here)).over(onward)
    opens = (F.col("delta") > 0) | (~F.trim("code").rlike("[;{}]$") & F.coalesce(F.startswith(F.col("next_code"), F.lit("{")), F.lit(False)))
    # A type's header may go on over lines before its brace.
    headed = F.col("d.kind").isin("class", "interface", "enum", "trait", "object", "case-class", "annotation", "graphql-type", "graphql-input", "graphql-enum") & ~F.trim("code").rlike("[;{}]$")
    rows = rows.withColumn("top", F.when(F.col("depth") == 0, pick(True))).withColumn("d", F.col("top"))
    first_brace = F.first(F.when(F.trim("code").rlike("[;{}]$"), F.col("delta")), ignorenulls=True).over(onward)
    opens = opens | (F.coalesce(headed, F.lit(False)) & (F.coalesce(first_brace, F.lit(0)) > 0))
    rows = rows.withColumn("top_end", F.when(opens, F.coalesce(closes(0), here)).otherwise(here))
    private = F.col("decl").rlike("^\\s*(?:(?:static|final|abstract|override|lazy|implicit|sealed|readonly)\\s+)*private\\b")
    exported = F.col("code").rlike("^\\s*export\\b") | F.coalesce(F.array_contains("exported", F.col("top.name")), F.lit(False))
    rows = rows.withColumn("shown", ~private & (~F.col("language").isin(*JS) | (F.col("depth") > 0) | exported))
    owner = F.last(F.when(F.col("top").isNotNull(), F.struct("v", "n", "top.kind", "top.name", F.col("top_end.v").alias("end"), "shown")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("owner", owner).withColumn("owner", F.when((F.col("depth") >= 1) & (F.col("owner.end") >= F.col("v")), F.col("owner")))
    member = F.when((F.col("depth") == 1) & F.col("owner").isNotNull(), pick(False, F.col("owner.kind")))
    rows = rows.withColumn("member", member).withColumn("d", F.coalesce("top", "member"))
    rows = rows.withColumn("end", F.when(F.col("top").isNotNull(), F.col("top_end")).when(opens, F.coalesce(closes(1), here)).otherwise(here))
    # Annotations and comments stand in the statements between the last one of code and the declaration.
    alone = F.col("code").rlike(f"^\\s*(?:{_MARK}\\s*)+$")
    marks = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("line", "\\s*\\n\\s*", " "), "//[^\"']*$", ""), F.lit(_RAW_MARK), F.lit(0))
    rows = rows.withColumn("mark", F.when(alone, marks))
    rows = rows.withColumn("note", F.when((F.trim("code").isin("", "\"\"")) & (F.trim("line") != ""), F.trim("line")))
    rows = rows.withColumn("run", F.sum(F.when(F.col("mark").isNull() & ~F.trim("code").isin("", "\"\""), 1).otherwise(0)).over(ahead))
    in_run = Window.partitionBy(*FILE, "run").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # Marks ahead of the declaration on its own line.
    leading = F.regexp_extract(F.regexp_replace("line", "\\s*\\n\\s*", " "), f"^\\s*((?:{_RAW_MARK}\\s+)+)(?=\\w)", 1)
    inline = F.regexp_extract_all(leading, F.lit(_RAW_MARK), F.lit(0))
    declares = F.col("d").isNotNull()
    rows = rows.withColumn("annotations", F.when(declares, F.concat(F.flatten(F.collect_list("mark").over(in_run)), inline)))
    return rows.withColumn("notes", F.when(declares, F.collect_list("note").over(in_run)))


def _comment(notes: Column, language: Column) -> Column:
    """The documentation comment right ahead of a declaration, without its marks."""
    joined = F.array_join(notes, "\n")
    block = F.regexp_extract(joined, "(?s)/\\*\\*(.*?)\\*/[^/]*$", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(block, "(?m)^\\s*\\*+ ?", ""), "^\\s+|\\s+$", ""))
    last = F.regexp_replace(F.regexp_replace(F.element_at(notes, -1), "^[#\"]+\\s*", ""), "\"+$", "")
    out = F.when(language == "graphql", F.when(F.size(notes) > 0, last)).otherwise(plain)
    return F.when(out != "", out)


def _headers(rows: DataFrame) -> DataFrame:
    """(file, v, header): a type's code from its first statement up to its brace, on one line."""
    order = Window.partitionBy(*FILE).orderBy("v")
    tops = rows.where("depth = 0").withColumn("at", F.last(F.when(F.col("top").isNotNull(), F.col("v")), ignorenulls=True).over(order)).where("at is not null")
    lines = tops.groupBy(*FILE, "at").agg(F.array_sort(F.collect_list(F.struct("v", F.regexp_replace("decl", "\\s+", " ").alias("decl")))).alias("l"))
    return lines.select(*FILE, F.col("at").alias("v"), F.substring_index(F.array_join(F.transform("l", lambda x: x["decl"]), " "), "{", 1).alias("header"))


def _names(clause: Column) -> Column:
    """Comma-separated type names without what stands in angle brackets or ahead of dots."""
    bare = reduce(lambda c, _: F.regexp_replace(c, "<[^<>]*>", ""), range(4), clause)
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(F.element_at(F.split(F.trim(x), "\\s|\\."), -1))), lambda x: x != "")


def _calls(rows: DataFrame) -> DataFrame:
    """(file, v, call_sites, jsx_elements) of the method or function that begins with statement v."""
    order = Window.partitionBy(*FILE).orderBy("v")
    callable_ = F.when(F.col("language") == "java", F.col("member.kind").isin("method", "constructor")).otherwise(F.col("top.kind").isin("function", "constant") & F.col("language").isin(*JS))
    unit = F.last(F.when(F.coalesce(callable_, F.lit(False)), F.struct("v", F.col("end.v").alias("end"))), ignorenulls=True).over(order)
    body = rows.withColumn("unit", unit).where("unit.end >= v").withColumn("code", F.when(F.col("unit.v") == F.col("v"), F.regexp_extract("code", "(?s)(?:\\{|=>|=)(.*)$", 1)).otherwise(F.col("code")))
    sites = F.transform(F.regexp_extract_all("code", F.lit(_CALL), F.lit(1)), lambda c: F.struct(
        F.element_at(F.split(c, "\\s*\\.\\s*"), -1).alias("target"), F.when(c.contains("."), F.trim(F.substring_index(c, ".", 1))).alias("receiver")))
    sites = F.filter(sites, lambda c: ~c["target"].isin(_NO_CALLS))
    jsx = F.when(F.col("language").isin("tsx", "javascript"), F.regexp_extract_all("code", F.lit("(?<![\\w)])<([A-Za-z][\\w.]*)(?=[\\s/>]|$)"), F.lit(1)))
    found = body.select(*FILE, F.col("unit.v").alias("at"), "v", sites.alias("sites"), jsx.alias("jsx")).where("size(sites) > 0 or size(jsx) > 0")
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("v", c))), lambda x: x[c]))
    return found.groupBy(*FILE, "at").agg(flat("sites").cast(CALL_SITES).alias("call_sites"), F.array_distinct(F.flatten(F.collect_list("jsx"))).alias("jsx_elements")).withColumnRenamed("at", "v")


def _operations(files: DataFrame) -> DataFrame:
    """(file, name, gql_operation_type, gql_fields) of constants that hold a GraphQL operation without variables."""
    pattern = "\\bconst\\s+\\w+[^=\\n]*=\\s*gql\\s*`[^`]*`"
    each = files.where(F.col("language").isin(*JS)).select(*FILE, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("whole"))
    content = F.regexp_extract("whole", "(?s)`(.*)`", 1)
    kind = F.regexp_extract(content, "^\\s*(query|mutation|subscription)\\s+\\w+\\s*\\{", 1)
    lines = F.transform(F.split(F.regexp_extract(content, "(?s)^[^{]*\\{(.*)$", 1), "\\n"), lambda t: F.trim(t))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("fields"))
    walked = F.aggregate(lines, start, lambda acc, t: F.struct(
        F.when(t == "}", acc["depth"] - 1).otherwise(acc["depth"] + F.when((acc["depth"] >= 0) & t.contains("{"), 1).otherwise(0)).alias("depth"),
        F.when((acc["depth"] == 0) & t.rlike("^\\w"), F.concat(acc["fields"], F.array(F.regexp_extract(t, "^(\\w+)", 1)))).otherwise(acc["fields"]).alias("fields"),
    ))
    out = each.select(*FILE, F.regexp_extract("whole", "\\bconst\\s+(\\w+)", 1).alias("name"), kind.alias("gql_operation_type"), walked["fields"].alias("gql_fields"))
    return out.where("gql_operation_type <> ''").dropDuplicates([*FILE, "name"])


def _api_calls(rows: DataFrame) -> DataFrame:
    """Symbols of calls to absolute paths, one a line of a statement, named after the function around them."""
    order = Window.partitionBy(*FILE).orderBy("v")
    rows = rows.where(F.col("language").isin(*JS))
    within = lambda c: F.last(F.when(c, F.struct("d.name", F.col("end.v").alias("end"))), ignorenulls=True).over(order)
    rows = rows.withColumn("method_at", within(F.col("member.kind") == "method")).withColumn("function_at", within(F.col("top.kind").isin("function", "constant")))
    lines = F.posexplode(F.arrays_zip(F.split("line", "\n").alias("line"), F.split("blank", "\n").alias("blank"))).alias("k", "both")
    hit = rows.where(F.col("line").rlike(_API)).select(*FILE, "language", "package_name", "file_ord", "v", "n", "method_at", "function_at", lines)
    hit = hit.select("*", "both.line", "both.blank").withColumn("n", F.col("n") + F.col("k")).where(F.col("line").rlike(_API) & (F.trim("blank") != ""))
    around = F.coalesce(F.when(F.col("method_at.end") >= F.col("v"), F.col("method_at.name")), F.when(F.col("function_at.end") >= F.col("v"), F.col("function_at.name")), F.concat(F.lit("api_call_"), (F.col("n") + 1).cast("string")))
    verb = F.upper(F.regexp_extract("line", _API, 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", _API, 2), "\\$\\{[^}]*\\}", "{param}"), "(?<=.)/$", "")
    return hit.select(*FILE, "language", "package_name", "file_ord", "v", "n", (F.col("k") + 1).alias("rank"), around.alias("name"), F.lit("api-call").alias("kind"), F.when(verb == "", "GET").otherwise(verb).alias("api_method"), path.alias("api_path"), F.col("n").alias("end_n"))


def extract_symbols(files: DataFrame) -> DataFrame:
    """Rows of schema.SYMBOLS, in the order of their lines within each file.

    Private members, and whatever a module does not export, are left out with all they hold.
    Exported functions count as hooks (use...) or, in JSX files, as components
    (capitalized); fields of a schema's root types are operations at the top. Files with a
    null text give nothing.
    """
    rows = _declared(files.where("text is not null"))
    js = F.col("language").isin(*JS)
    seen = rows.where(F.col("d").isNotNull() & F.col("shown") & F.coalesce(F.col("owner.shown"), F.lit(True)))
    seen = seen.where(F.col("top").isNotNull() | F.col("member").isNotNull())
    seen = seen.where((F.col("language") != "graphql") | ~F.col("d.name").isin(*_ROOTS) | F.col("member").isNotNull())
    # Enum constants may share a line.
    several = F.when((F.col("d.kind") == "constant") & (F.col("language") == "java"), F.regexp_extract_all("decl", F.lit(_CONSTANTS), F.lit(1))).otherwise(F.array("d.name"))
    seen = seen.withColumn("name", F.explode(F.when(F.size(several) > 0, several).otherwise(F.array("d.name"))))
    function = js & ((F.col("d.kind") == "function") | ((F.col("d.kind") == "constant") & F.col("top").isNotNull() & F.col("code").rlike("=\\s*(?:async\\s*)?(?:function\\b|\\(|\\w+\\s*=>|<)") & F.concat_ws(" ", "code", "next_code").rlike("=>|function")))
    kind = F.when(function & F.col("name").rlike("^use[A-Z]"), "hook").when(function & F.col("name").rlike("^[A-Z]") & F.col("language").isin("tsx", "javascript"), "component").when(function, "function").otherwise(F.col("d.kind"))
    root = F.create_map(*[F.lit(x) for kv in _ROOTS.items() for x in kv])[F.col("owner.name")]
    kind = F.when((F.col("language") == "graphql") & root.isNotNull(), root).otherwise(kind)
    modifiers = F.regexp_extract("decl", f"^\\s*({_MODS})", 1)
    visibility = F.when(modifiers.rlike("\\bprotected\\b"), "protected").when((F.col("language") == "java") & ~modifiers.rlike("\\bpublic\\b") & (F.col("d.kind") != "constant"), "default").otherwise("public")
    signature = F.regexp_replace(F.regexp_replace("line", f"^\\s*(?:{_RAW_MARK}\\s+)+(?=\\w)", ""), "\\s*\\n\\s*", " ")
    signature = F.trim(F.regexp_replace(signature, "\\s*[{};]\\s*$", ""))
    for language, most in SIGNATURE.items():
        signature = F.when(F.col("language") == language, F.substring(signature, 1, most)).otherwise(signature)
    extends = F.regexp_extract("header", "\\bclass\\s+\\w+(?:\\s*<[^{]*?>)?\\s+extends\\s+([\\w.]+)", 1)
    extends = F.when(F.col("language") != "scala", F.when(extends != "", F.element_at(F.split(extends, "\\."), -1)))
    implements = F.when((F.col("d.kind") != "interface") & (F.col("language") != "scala"), F.regexp_extract("header", "\\bimplements\\s+(.+)$", 1))
    out = seen.join(_headers(rows), [*FILE, "v"], "left").join(_calls(rows), [*FILE, "v"], "left")
    out = out.select(
        *FILE, "language", "package_name", "file_ord", "v", "n", F.lit(0).alias("rank"), "name", kind.alias("kind"), visibility.alias("visibility"), signature.alias("signature"), _comment(F.col("notes"), F.col("language")).alias("doc_comment"),
        "annotations", F.when(F.col("top").isNotNull(), extends).alias("extends_name"), F.when(F.col("top").isNotNull() & (implements != ""), _names(implements)).alias("implements_names"),
        F.when(F.col("kind").isin(*_FUNCTIONS, "method", "constructor"), F.col("call_sites")).alias("call_sites"), "jsx_elements", F.col("end.n").alias("end_n"),
        F.when(F.col("member").isNotNull() & root.isNull(), F.col("owner.v")).alias("parent_v"), F.col("top").isNotNull().alias("is_top"),
    )
    out = out.unionByName(_api_calls(rows), allowMissingColumns=True).join(_operations(files), [*FILE, "name"], "left")
    is_operation = F.coalesce(F.col("is_top") & (F.col("kind") == "constant"), F.lit(False)) & F.col("gql_operation_type").isNotNull()
    out = out.withColumns({"kind": F.when(is_operation, "gql-operation").otherwise(F.col("kind")), **{c: F.when(is_operation, F.col(c)) for c in ("gql_operation_type", "gql_fields")}})
    order = Window.partitionBy(*FILE).orderBy("v", "rank", "name")
    out = out.withColumn("sym_ord", F.row_number().over(order) - 1)
    parent = F.last(F.when(F.col("is_top"), F.struct("v", "sym_ord")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("p", parent).withColumn("parent_ord", F.when(F.col("p.v") == F.col("parent_v"), F.col("p.sym_ord")))
    out = out.withColumn("start_line", F.col("n") + 1).withColumn("end_line", F.col("end_n") + 1).withColumn("visibility", F.coalesce("visibility", F.lit("public")))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SYMBOLS.fields])


def imports_of(files: DataFrame) -> DataFrame:
    """(module, file_path, import_path) as the languages name them."""
    lines = files.select(*FILE, "language", F.explode(F.split("text", "\\r?\\n")).alias("line"))
    dotted = F.regexp_extract("line", "^\\s*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*|\\._)?)\\s*;?\\s*$", 1)
    quoted = F.regexp_extract("line", "^\\s*(?:(?:import|export)\\b.*?|\\}\\s*from\\s*)[\"']([^\"']+)[\"']", 1)
    path = F.when(F.col("language").isin("java", "scala"), F.regexp_replace(dotted, "\\._$", ".*")).when(F.col("language") != "graphql", quoted)
    return lines.withColumn("import_path", path).where("import_path <> ''").select(*FILE, "import_path").distinct()
